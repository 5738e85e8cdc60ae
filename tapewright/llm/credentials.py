"""Operator 13: secrets in texts, and the parts of credentials that are reported only where the others stand near. SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, doc_columns

#: Kinds of spans, in the order in which those of one start are listed. The first three are reported wherever they stand.
KINDS = ("assign", "access", "hex", "key", "short", "user", "endpoint")
LINK = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){LINK}([A-Za-z0-9+/_.=-]+)",
    # runs that are long enough: what the pattern without a bound finds and a test of length keeps is the same
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "key": r"[A-Za-z0-9+/_=-]{20,}",
    "user": rf"(?i:user_?name|user|login|account|client_?id|key_?id){LINK}[A-Za-z0-9@._-]{{3,}}",
    "endpoint": rf"(?:(?i:https?|wss?|ftps?|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|rediss?|mongodb|amqps?|s3)://|(?i:endpoint|hostname|host|server){LINK})[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{{3,}}",
}
BREAK = r"\n[ \t\r]*\n"  # between two scopes
#: What a span can be of a credential.
PARTS = {"strong": ("access",), "weak": ("user",), "secret": ("assign", "key", "short"), "endpoint": ("endpoint",)}


def valid(kind: str, match: Column) -> Column:
    """The kind of a match's span, as its place in KINDS; null where it is none."""
    number = F.lit(KINDS.index(kind))
    if kind == "assign":
        size = F.char_length(F.regexp_extract(match, PATTERNS[kind], 1))
        return F.when(size >= 12, number).when(size >= 6, F.lit(KINDS.index("short")))
    if kind == "key":
        return F.when(match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]"), number)
    return number


def spots(docs: DataFrame) -> DataFrame:
    """rid, doc_id, parts: of each row, the matches of each pattern with what lies between them, without the text.

    Weak candidates matter only beside an identifier, so texts with none aren't searched for them.
    """
    all_of = lambda k: F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))
    first = doc_columns(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", *(all_of(k).alias(k) for k in ("assign", "access", "hex", "user")))
    second = first.select("*", *(F.when((F.size("access") > 0) | (F.size("user") > 0), all_of(k)).otherwise(F.array().cast("array<string>")).alias(k) for k in ("key", "endpoint")))
    third = second.select("*", *(F.when(F.size(k) > 0, F.split("text", PATTERNS[k], -1)).alias(f"{k}_gaps") for k in PATTERNS))

    def part(kind):
        def one(match, i):
            gap = F.get(F.col(f"{kind}_gaps"), i)
            return F.struct(F.lit(KINDS.index(kind)).alias("of"), F.char_length(gap).alias("gap"), F.char_length(match).alias("size"), F.regexp_count(gap, F.lit(BREAK)).alias("breaks"), valid(kind, match).alias("kind"))

        return F.when(F.size(kind) > 0, F.transform(kind, one)).otherwise(F.array().cast("array<struct<of:int,gap:int,size:int,breaks:int,kind:int>>"))

    return third.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*(part(k) for k in PATTERNS)).alias("parts"))


def placed(found: DataFrame) -> DataFrame:
    """rid, kind, start, end, scope: spans by code points, and the number of breaks before each.

    Places are running sums over a text's matches of one pattern, by a window, whose rows can be spilled.
    """
    each = found.where(F.size("parts") > 0).select("rid", F.posexplode("parts").alias("at", "p")).select("rid", "at", "p.*")
    so_far = Window.partitionBy("rid", "of").orderBy("at")
    ended = each.select("rid", "kind", "size", F.sum((F.col("gap") + F.col("size")).cast("long")).over(so_far).alias("end"), F.sum("breaks").over(so_far).alias("scope"))
    return ended.where("kind is not null").select("rid", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "scope")


def beside(spans: DataFrame, reach: int) -> DataFrame:
    """rid, scope, bin and, for each part of a credential, its last start in the bin before, whether the bin has it, and its first start in the bin after.

    Bins are as wide as ``reach``, so starts of one bin lie within it, and others within it lie in the bins beside. A bin
    is reduced to its first and last start of each part before it is sent on, so an interval join needs no pairs.
    """
    numbers = {p: [KINDS.index(k) for k in kinds] for p, kinds in PARTS.items()}
    part = F.coalesce(*(F.when(F.col("kind").isin(n), F.lit(p)) for p, n in numbers.items()))
    ends = spans.withColumn("part", part).where("part is not null").groupBy("rid", "scope", F.floor(F.col("start") / reach).alias("own"), "part").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    near = ends.select("rid", "scope", "part", "low", "high", "own", F.explode(F.array(*(F.col("own") + k for k in (-1, 0, 1)))).alias("bin"))
    out = []
    for p in PARTS:
        mine = F.col("part") == p
        out += [F.max(F.when(mine & (F.col("own") < F.col("bin")), F.col("high"))).alias(f"{p}_before"), F.count_if(mine & (F.col("own") == F.col("bin"))).alias(f"{p}_here"), F.min(F.when(mine & (F.col("own") > F.col("bin")), F.col("low"))).alias(f"{p}_after")]
    return near.groupBy("rid", "scope", "bin").agg(*out)


def linked(spans: DataFrame, reach: int) -> DataFrame:
    """rid, kind, start, end of weak candidates whose complementary parts start within ``reach`` code points, in their scope.

    A key or a short value needs an access identifier, or a user name and an endpoint; a user name needs a secret and an
    endpoint; an endpoint needs an identifier and a secret.
    """
    weak = spans.where(F.col("kind") >= KINDS.index("key")).withColumn("bin", F.floor(F.col("start") / reach))
    has = {p: (F.col(f"{p}_here") > 0) | F.coalesce(F.col("start") - F.col(f"{p}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{p}_after") - F.col("start") <= reach, F.lit(False)) for p in PARTS}
    rules = {"key": has["strong"] | (has["weak"] & has["endpoint"]), "user": has["secret"] & has["endpoint"], "endpoint": (has["strong"] | has["weak"]) & has["secret"]}
    rules["short"] = rules["key"]
    holds = F.coalesce(*(F.when(F.col("kind") == KINDS.index(k), rule) for k, rule in rules.items()))
    return weak.join(beside(spans, reach), ["rid", "scope", "bin"]).where(holds).select("rid", "kind", "start", "end")


def written(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])))


def scan(docs: DataFrame, reach: int = 500) -> DataFrame:
    """Secrets of each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Always reported (base spans): values of 12 or more characters assigned to a name of a secret (the match from the
    name on), access identifiers, and runs of 16 or more hexadecimal digits. Reported only where the parts that make up a
    credential stand within ``reach`` code points in one scope, the text between two blank lines: long mixed runs (key),
    assigned values of 6 to 11 characters (short), user names and endpoints; see ``linked``. Spans are kind:start:end, by
    start and then kind, end exclusive, in code points.

    A null or empty text has no spans; each row counts, with its own doc_id, null or repeated. A text is searched whole by
    the engine's functions; its spans are sorted in one value, as the result asks. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "credentials")
    found = scratch.put(spots(docs), "spots")
    spans = scratch.put(placed(found), "spans")
    base = F.col("kind") < KINDS.index("key")
    told = spans.where(base).select("rid", "kind", "start", "end").unionByName(linked(spans, reach))
    per = told.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("own"), *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])))
    none = F.lit(0).cast("long")
    out = found.where(F.size("parts") > 0).select("rid", "doc_id").join(per, "rid", "left").unionByName(found.where(F.size("parts") == 0).select("rid", "doc_id"), allowMissingColumns=True)
    own = F.coalesce("own", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return out.select("doc_id", *(F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(written(F.filter(own, lambda s: s["kind"] < KINDS.index("key"))), 256).alias("base_sha256"), written(own).alias("spans"))
