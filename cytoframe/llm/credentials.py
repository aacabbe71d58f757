"""Secret scans: parts of credentials found by pattern, and weak ones reported only beside their complements; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Kinds in the order in which equal starts are listed.  The first three are sure by themselves, the others weak.
BASE, WEAK = ("assign", "access", "hex"), ("ident", "opaque", "endpoint")
KINDS = BASE + WEAK
#: What a part can stand for in a credential.
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "ident": "id", "endpoint": "endpoint"}
#: A weak part is reported where a part of each of these roles lies near it.
NEEDS = {"ident": ("secret",), "opaque": ("id",), "endpoint": ("id", "secret")}
#: Most code points between the near edges of two parts that belong together.
REACH = 400


def _either(words: str) -> str:
    """A pattern's ASCII letters in either case, spelt out: engines differ in what they fold."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"({_either('password|passwd|secret|token|api_?key')}){_GIVEN}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ENDPOINT = rf"{_either('(?:https?|ftp|sftp|ssh|ldaps?|amqps?|redis|mysql|mongodb|postgres(?:ql)?|s3)')}://[A-Za-z0-9_.~%:@/?&=+-]+"
IDENT = rf"(?:{_either('user(?:name)?|login|account|client_?id|key_?id')}){_GIVEN}[A-Za-z0-9+/_.@=-]{{3,}}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
#: One pattern for the weak kinds, so that they do not overlap one another.
WEAKLY = f"{ENDPOINT}|{IDENT}|{OPAQUE}"
#: Scopes are stretches of text between blank lines.
BREAK = r"\n[\x20\x09\x0D]*\n"


def _weak_kind(m: Column) -> Column:
    """Which weak kind a match is; a long run is taken for a secret only if it mixes cases and digits."""
    mixed = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    return F.when(m.rlike(f"^(?:{ENDPOINT})"), "endpoint").when(m.rlike(f"^(?:{IDENT})"), "ident").when(mixed, "opaque")


#: Passes over the text: pattern, and the kind of a match or null where it fails.
PASSES = (
    (ASSIGN, lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, "assign")),
    (ACCESS, lambda m: F.when(F.length(m) >= 16, "access")),
    (HEX, lambda m: F.lit("hex")),
    (WEAKLY, _weak_kind),
)
_PART = "array<struct<pass:int,at:int,gap:int,size:int,kind:string,part:string>>"


def _matches(text: Column, number: int, pattern: str, kind) -> Column:
    """A pattern's matches in order, each with the code points since the match before it: their sums are the places."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    each = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    found = F.transform(
        F.filter(each, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(F.lit(number).alias("pass"), i.alias("at"), x["g"].alias("gap"), F.length(x["m"]).alias("size"), kind(x["m"]).alias("kind"), x["m"].alias("part")),
    )
    return F.when(text.rlike(pattern), found.cast(_PART)).otherwise(F.array().cast(_PART))


def find_parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Work table (row, doc_id, parts): every input row with its matches, written once, so that row numbers hold whatever is computed again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), F.concat(*(_matches(text, i, p, k) for i, (p, k) in enumerate(PASSES))).alias("parts"))
    # Blank lines matter only where a weak part has company.
    company = (F.size("parts") > 1) & F.exists("parts", lambda p: p["kind"].isin(*WEAK))
    breaks = F.when(company, _matches(F.col("text"), len(PASSES), BREAK, lambda m: F.lit("break"))).otherwise(F.array().cast(_PART))
    return materialise(found.select("row", "doc_id", F.concat("parts", breaks).alias("parts")), "parts")


def place_parts(found: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, part, scope) from a table of ``find_parts``: weak parts that overlap a sure one are left out."""
    # All that follows stays on this one shuffle of the matches; a text's own matches are all that meets.
    p = found.where(F.size("parts") > 0).select("row", "doc_id", F.explode("parts").alias("p")).repartition("row").select("row", "doc_id", "p.*")
    along = Window.partitionBy("row", "pass").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size")).where("kind IS NOT NULL")
    before, after = _sweeps("row")
    sure = F.col("kind").isin(*BASE)
    p = (
        p.withColumn("scope", F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("sure_before", F.max(F.when(sure, F.col("end"))).over(before))
        .withColumn("sure_after", F.min(F.when(sure, F.col("start"))).over(after))
    )
    overlaps = F.coalesce(F.col("sure_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("sure_after") < F.col("end"), F.lit(False))
    return p.where((F.col("kind") != "break") & (sure | ~overlaps)).select("row", "doc_id", "kind", "start", "end", "part", "scope")


def _order() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))


def _sweeps(*by: str):
    """Windows over all parts before a part and over all after it, in order of start, then kind; both run along the parts once."""
    w = Window.partitionBy(*by)
    far = (Window.unboundedPreceding, -1)
    return w.orderBy(F.col("start"), _order(), F.col("end")).rowsBetween(*far), w.orderBy(F.col("start").desc(), _order().desc(), F.col("end").desc()).rowsBetween(*far)


def link_parts(placed: DataFrame, reach: int = REACH) -> DataFrame:
    """The placed parts, each with the nearest identifier, secret and endpoint of its scope within ``reach`` (null: none), and ``reported``.

    An interval join of parts by role within a scope.  As only the nearest partner on either side decides, it is done by two
    running aggregates along the parts in order of start (the latest end so far, the earliest start still to come)
    and never pairs all parts of a scope.
    """
    before, after = _sweeps("row", "scope")
    role = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))[F.col("kind")]
    p = placed.withColumn("role", role)
    for r in ("id", "secret", "endpoint"):
        other = F.when(F.col("role") == r, F.struct("end", "start", "part"))
        ahead = F.when(F.col("role") == r, F.struct("start", "end", "part"))
        p = p.withColumn(f"{r}_before", F.max(other).over(before)).withColumn(f"{r}_after", F.min(ahead).over(after))
    for r in ("id", "secret", "endpoint"):
        b, a = F.col(f"{r}_before"), F.col(f"{r}_after")
        back = F.when(b.isNotNull(), F.greatest(F.col("start") - b["end"], F.lit(0)))
        ahead = F.when(a.isNotNull(), F.greatest(a["start"] - F.col("end"), F.lit(0)))
        span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["part"].alias("part"))
        p = p.withColumn(f"near_{r}", F.when(back <= F.least(ahead, F.lit(reach)), span(b)).when(ahead <= reach, span(a)))
    reported = F.col("kind").isin(*BASE)
    for kind, needs in NEEDS.items():
        all_near = F.lit(True)
        for r in needs:
            all_near = all_near & F.col(f"near_{r}").isNotNull()
        reported = reported | ((F.col("kind") == kind) & all_near)
    return p.select("row", "doc_id", "kind", "role", "start", "end", "part", "scope", "near_id", "near_secret", "near_endpoint", reported.alias("reported"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: (doc_id, spans), spans an array of (start, kind, end) in code points, end exclusive, by start, then kind.

    Sure parts (assignments of a password or key, access identifiers, long hexadecimal runs) are always there.  Weak ones (named
    users and accounts, long mixed runs, addresses of services) are there where parts that complete them lie in the
    same scope within ``reach``.  Null and empty texts have no spans; repeated rows and null ids come out each; very long
    texts are searched whole; an empty table gives no rows; other columns are not read, whatever their names.
    """
    found = find_parts(df, id_col, text_col)
    linked = link_parts(place_parts(found), reach).where("reported")
    each = F.struct("start", _order().cast("int").alias("order"), F.col("end"), "kind")
    # Rows without parts pass by the shuffle; rows all of whose parts fail come back through the left join's side.
    spans = linked.groupBy("row").agg(F.array_sort(F.collect_list(each)).alias("s"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    some = found.where(F.size("parts") > 0).select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("s", none).alias("s"))
    out = some.unionByName(found.where(F.size("parts") == 0).select("doc_id", none.alias("s")))
    return out.select("doc_id", F.transform("s", lambda x: F.struct(x["start"], x["kind"], x["end"])).alias("spans"))


def credentials(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per reported secret: (doc_id, kind, start, end, secret, identifier, endpoint): the texts of the secret and of its nearest partners, null where it has none."""
    linked = link_parts(place_parts(find_parts(df, id_col, text_col)), reach)
    return linked.where("reported AND role = 'secret'").select(
        "doc_id", "kind", "start", "end", F.col("part").alias("secret"), F.col("near_id")["part"].alias("identifier"), F.col("near_endpoint")["part"].alias("endpoint")
    )


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql_pass(number: int, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, {number} AS pass, unnest(range(len(m))) AS nth, unnest(m) AS m, unnest(list_transform(string_split_regex(text, '{p}')[:len(m)], lambda g: length(g))) AS gap
  FROM (SELECT rid, text, regexp_extract_all(text, '{p}') AS m FROM d) WHERE len(m) > 0"""


def oracle_sql(reach: int = REACH) -> str:
    """DuckDB SQL for the query's digest columns."""
    q = lambda p: p.replace("'", "''")
    roles = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE.items())
    orders = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    near = {r: f"(coalesce(start - max(CASE WHEN role = '{r}' THEN stop END) OVER b <= {reach}, false) OR coalesce(min(CASE WHEN role = '{r}' THEN start END) OVER a - stop <= {reach}, false))" for r in ("id", "secret", "endpoint")}
    needs = " ".join(f"WHEN '{k}' THEN {' AND '.join(near[r] for r in n)}" for k, n in NEEDS.items())
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), raw AS ({' UNION ALL '.join(_sql_pass(i, p) for i, p in enumerate((*(p for p, _ in PASSES), BREAK)))}
), placed AS (
  SELECT rid, m, sum(gap + length(m)) OVER (PARTITION BY rid, pass ORDER BY nth ROWS UNBOUNDED PRECEDING) AS stop, length(m) AS size,
    CASE pass WHEN 0 THEN CASE WHEN length(regexp_extract(m, '{q(ASSIGN)}', 2)) >= 8 THEN 'assign' END
      WHEN 1 THEN CASE WHEN length(m) >= 16 THEN 'access' END WHEN 2 THEN 'hex' WHEN 4 THEN 'break'
      ELSE CASE WHEN regexp_matches(m, '^(?:{q(ENDPOINT)})') THEN 'endpoint' WHEN regexp_matches(m, '^(?:{q(IDENT)})') THEN 'ident'
        WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') THEN 'opaque' END END AS kind
  FROM raw
), k AS (SELECT rid, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, kind, CASE kind {orders} ELSE -1 END AS ord, CASE kind {roles} END AS role FROM placed WHERE kind IS NOT NULL
), s AS (
  SELECT *, sum(CASE WHEN kind = 'break' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY start, ord, stop ROWS UNBOUNDED PRECEDING) AS scope,
    max(CASE WHEN ord BETWEEN 0 AND 2 THEN stop END) OVER (PARTITION BY rid ORDER BY start, ord, stop {frame}) AS sure_before,
    min(CASE WHEN ord BETWEEN 0 AND 2 THEN start END) OVER (PARTITION BY rid ORDER BY start DESC, ord DESC, stop DESC {frame}) AS sure_after
  FROM k
), u AS (SELECT * FROM s WHERE kind <> 'break' AND (ord <= 2 OR NOT (coalesce(sure_before > start, false) OR coalesce(sure_after < stop, false)))
), l AS (
  SELECT *, CASE kind {needs} ELSE true END AS reported FROM u
  WINDOW b AS (PARTITION BY rid, scope ORDER BY start, ord, stop {frame}), a AS (PARTITION BY rid, scope ORDER BY start DESC, ord DESC, stop DESC {frame})
), g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    {listed} FILTER (ord <= 2) AS base, {listed} AS spans
  FROM l WHERE reported GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
