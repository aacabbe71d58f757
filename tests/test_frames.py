"""Image files as tables, and batches of image sets, on files made here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.plans import batch
from cytoframe.sources import frames


def png(a, filters=(0,), interlace=0):
    a = a if a.ndim == 3 else a[:, :, None]
    size = a.dtype.itemsize
    raw = a.astype(a.dtype.newbyteorder(">")).tobytes()
    row, step = a.shape[1] * a.shape[2] * size, a.shape[2] * size
    out, up = b"", bytes(row)
    for r in range(a.shape[0]):
        kind, line = filters[r % len(filters)], raw[r * row : (r + 1) * row]
        done = bytearray()
        for i, x in enumerate(line):
            left, above, corner = (line[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = left + above - corner
            paeth = left if abs(p - left) <= abs(p - above) and abs(p - left) <= abs(p - corner) else above if abs(p - above) <= abs(p - corner) else corner
            done.append((x - (0, left, above, (left + above) // 2, paeth)[kind]) & 255)
        out, up = out + bytes([kind]) + bytes(done), line
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2]]
    z = zlib.compress(out)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], size * 8, colour, 0, 0, interlace)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", z[:20]) + chunk(b"IDAT", z[20:]) + chunk(b"IEND", b"")


def tiff(a, order="<", strips=2, compression=1, text=None, when=None):
    a = a if a.ndim == 3 else a[:, :, None]
    data = [x.astype(a.dtype.newbyteorder(order)).tobytes() for x in np.array_split(a, strips)]
    tags = [(256, 3, [a.shape[1]]), (257, 4, [a.shape[0]]), (258, 3, [a.dtype.itemsize * 8] * a.shape[2]), (259, 3, [compression]), (277, 3, [a.shape[2]])]
    body, starts = b"", []
    for d in data:
        starts.append(8 + len(body))
        body += d
    tags += [(273, 4, starts), (279, 4, [len(d) for d in data])] + [(t, 2, s.encode() + b"\0") for t, s in ((270, text), (306, when)) if s]
    entries, extra, base = b"", b"", 8 + len(body) + 2 + 12 * len(tags) + 4
    for t, kind, v in sorted(tags):
        raw = v if kind == 2 else struct.pack(order + {3: "H", 4: "I"}[kind] * len(v), *v)
        if len(raw) <= 4:
            entries += struct.pack(order + "HHI", t, kind, len(v)) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "HHII", t, kind, len(v), base + len(extra))
            extra += raw
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body)) + body + struct.pack(order + "H", len(tags)) + entries + bytes(4) + extra


R = np.random.default_rng(4)
IMAGES = {
    "gray8.png": (R.integers(0, 256, (7, 9)).astype(np.uint8), lambda a: png(a, (0, 1, 2, 3, 4))),
    "gray16.png": (R.integers(0, 65536, (5, 4)).astype(np.uint16), lambda a: png(a, (4, 3, 1))),
    "rgb.png": (R.integers(0, 256, (6, 5, 3)).astype(np.uint8), lambda a: png(a, (2, 4, 1, 3))),
    "little.tif": (R.integers(0, 65536, (9, 6)).astype(np.uint16), lambda a: tiff(a, "<", 3, text="lamp 40", when="2026:01:02 13:14:15")),
    "big.tif": (R.integers(0, 65536, (4, 3)).astype(np.uint16), lambda a: tiff(a, ">", 1, text="<OME xmlns='x'/>")),
    "rgb.tif": (R.integers(0, 256, (4, 3, 3)).astype(np.uint8), lambda a: tiff(a, "<", 2)),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    for name, (a, make) in IMAGES.items():
        (d / name).write_bytes(make(a))
    whole = png(IMAGES["gray8.png"][0])
    bad = {"notes.txt": b"no image", "empty.png": b"", "cut.png": whole[:60], "laced.png": png(IMAGES["gray8.png"][0], interlace=1), "packed.tif": tiff(IMAGES["big.tif"][0], compression=5)}
    for name, b in bad.items():
        (d / name).write_bytes(b)
    return d


def name(p):
    return p.rsplit("/", 1)[1]


def test_pixels_equal_what_was_written(spark, folder):
    rows = frames.decode(frames.image_files(spark, str(folder))).collect()
    got = {}
    for r in rows:
        if r.reason is None:
            got.setdefault(name(r.path), {})[r.r] = np.array(r.v).T
    for n, (a, _) in IMAGES.items():
        b = np.stack([got[n][i] for i in range(len(got[n]))])
        assert (b == (a if a.ndim == 3 else a[:, :, None])).all(), n
    reasons = {name(r.path): r.reason for r in rows if r.reason}
    assert reasons.pop("cut.png").startswith("broken file")
    assert reasons == {"notes.txt": "neither PNG nor TIFF", "laced.png": "interlaced PNG", "packed.tif": "compressed TIFF"}


def test_metadata_decodes_no_pixels(spark, folder):
    m = frames.metadata(frames.image_files(spark, str(folder)))
    assert "Python" not in m._jdf.queryExecution().toString() and "Pandas" not in m._jdf.queryExecution().toString()
    by = {name(r.path): r for r in m.collect()}
    assert {n: (r.height, r.width, r.bits, r.samples) for n, r in by.items() if n in IMAGES} == {n: (a.shape[0], a.shape[1], a.dtype.itemsize * 8, 1 if a.ndim == 2 else 3) for n, (a, _) in IMAGES.items()}
    assert by["little.tif"].description == "lamp 40" and str(by["little.tif"].date_time) == "2026-01-02 13:14:15" and by["big.tif"].ome_xml == "<OME xmlns='x'/>"
    assert by["notes.txt"].kind is None and by["gray8.png"].tags is None and {t.tag for t in by["big.tif"].tags} == {256, 257, 258, 259, 273, 277, 279}
    names = frames.image_files(spark, str(folder)).select("path", "length")
    assert "content" not in names._jdf.queryExecution().executedPlan().toString()


def test_planes(spark, folder):
    rows = frames.decode(frames.image_files(spark, str(folder), "rgb.*"))
    with pytest.raises(ValueError, match="method"):
        frames.plane(rows)
    with pytest.raises(ValueError, match="must be one of"):
        frames.plane(rows, "best")
    a = IMAGES["rgb.png"][0].astype(float)
    want = {"gray": a @ np.array(frames.GRAY), "green": a[:, :, 1], "mean": a.mean(2), "red": a[:, :, 0]}
    for method, w in want.items():
        px = frames.long_pixels(frames.plane(rows, method)).where(F.col("path").endswith("rgb.png")).collect()
        assert len(px) == w.size and all(abs(p.v - w[p.r, p.c]) < 1e-9 for p in px)


def field(cells, shape=(40, 50), noise=0):
    a = R.integers(5, 15, shape).astype(np.uint8)
    for r, c in cells:
        a[r : r + 6, c : c + 6] = 150
    return a


def test_batch_refuses_sets_and_goes_on(spark, tmp_path):
    put = lambda n, b: (tmp_path / n).write_bytes(b)
    put("g1.png", png(field([(5, 5), (20, 30)])))
    put("r1.png", png(field([(5, 5), (20, 30)]) // 2))
    put("g2.tif", tiff(field([])))
    put("small.png", png(field([], (10, 10))))
    put("full.png", png(np.where(np.indices((40, 50))[0] < 20, 200, 10).astype(np.uint8)))
    put("cut.png", png(field([(5, 5)]))[:90])
    put("odd.png", b"odd")
    path = lambda n: f"file:{tmp_path}/{n}"
    sets = [("s1", "g1.png", "r1.png"), ("s2", "g1.png", "small.png"), ("s3", "g1.png", "odd.png"), ("s4", "gone.png", "r1.png"), ("s5", "full.png", "full.png"), ("s6", "cut.png", "r1.png"), ("s7", "g1.png", "r1.png")]
    manifest = spark.createDataFrame([("x" if s == "s7" else "d", "c", s, path(g), path(r)) for s, g, r in sets], "session_id string, condition_id string, sample_id string, green_path string, red_path string")
    good, px, refused = batch.read_sets(manifest, frames.image_files(spark, str(tmp_path)))
    why = {r.sample_id: r.reason for r in refused.collect()}
    assert why.pop("s6").startswith("broken file")
    assert why == {"s2": "green and red differ in shape", "s3": "red: neither PNG nor TIFF", "s4": "green file not found"}
    bleed = spark.createDataFrame([("d", 0.1)], "session_id string, bleed double")
    cells, out = batch.process_sets(good, px, coefficients=bleed, min_size=10)
    assert {r.sample_id: r.reason for r in out.collect()} == {"s5": "foreground fraction 0.5000 is outside 0.001 to 0.2", "s7": "no crosstalk coefficient for the session"}
    rows = cells.orderBy("cell_id").collect()
    assert [(r.sample_id, r.area_px, r.edge_flag, r.sat_flag) for r in rows] == [("s1", 36, False, False)] * 2
    assert all(r.raw_mean_green == 150 and r.raw_mean_red == 75 and abs(r.corrected_mean_red - (75 - 15 - r.local_background_red)) < 1e-9 for r in rows)
    with pytest.raises(ValueError, match="every image set"):
        batch.process_sets(good, px, least=0.9, most=1.0)
