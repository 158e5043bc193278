"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds: assign, access and hex. The method proposes more candidates (kind
``live``: long tokens with digits and capitals that no base span touches), hashes every
candidate and counts the distinct repositories and owners that hold each hash. A value
that COPIED_OWNERS owners or COPIED_REPOS repositories hold is a widely copied example;
one that fewer hold is likely live. Base spans always stay; a ``live`` span stays only if
its value is owner-specific.

A repository is a combination of the columns repo_cols, an owner one of owner_cols. The
table documents names only a source: there the source is the owner, and what it holds in
one language is a repository.

Positions come from two passes of one pattern: the pieces between its matches and
the matches themselves alternate, so their running lengths are the offsets. A text
without any of a pattern's letters in place skips that pattern.

The count is grouped by (hash, repository, owner) first and by hash after that, with
partial sums before either shuffle, so a value in a third of all rows is one row per
task. Where the counts go back to the candidates, a hash of more than HOT candidates is
dealt to salted copies of its count; the list of such hashes has at most one row for HOT
candidates. Texts are scanned once: the spans are written, and only they are shuffled.

Defined cases: a null text is empty; a null repository or owner counts as one of its
own; a null id is kept; repeated rows give repeated results; an empty table no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LIVE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9a-z+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "live")
#: A value that this many owners, or repositories, hold is an example that people copy.
COPIED_OWNERS, COPIED_REPOS = 3, 5
HOT = 65_536
#: Matches that are placed one after another; chunks of them are placed by their sums.
CHUNK = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """The spans of pattern in text whose group has least characters or more."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), values.alias("v"))
    rank = KINDS.index(kind)

    def long(c: Column) -> Column:
        return F.aggregate(c, F.lit(0), lambda total, x: total + F.length(x["b"]) + F.length(x["w"]))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["w"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(F.length(x["v"]) >= least, F.array(span)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))).alias("out"))

    def place(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out")), step, lambda acc: acc["out"])

    # an array that grows by one a match would be copied as often as there are matches
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, CHUNK))
    starts = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + long(c))))
    many = F.flatten(F.zip_with(chunks, F.slice(starts, 1, F.size(chunks)), place))
    return F.when(F.size(whole) <= CHUNK, place(steps, F.lit(0))).otherwise(many)


def found(text: Column, lower: Column) -> tuple[Column, Column]:
    """Base spans, and the further candidates."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    word = F.lit(False)
    for k in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        word = word | F.contains(lower, F.lit(k))
    base = F.concat(
        F.when(word, matches(text, ASSIGN, "assign", 2, 6)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, "access")).otherwise(none),
        F.when(F.regexp_like(text, F.lit(r"[0-9a-f]{24}")), matches(text, HEX, "hex")).otherwise(none),
    )
    return base, F.when(F.regexp_like(text, F.lit(r"[A-Za-z0-9+/_=-]{20}")), matches(text, LIVE, "live")).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(rows: DataFrame) -> DataFrame:
    """rows (doc_id, body, repo, owner) with the spans base and more, and a key that repeated rows share."""
    base, more = found(F.col("body"), F.lower("body"))
    rows = rows.withColumn("base", base).withColumn("more", more)
    rows = rows.withColumn("more", F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))
    return rows.withColumn("key", F.struct("doc_id", F.xxhash64("body", "repo", "owner").alias("h")))


def judge(rows: DataFrame) -> DataFrame:
    """(hash, key, x, n_repos, n_owners): each candidate span x with who else holds its value."""
    busy = rows.where(F.size("base") + F.size("more") > 0).select("key", "repo", "owner", F.explode(F.concat("base", "more")).alias("x"))
    busy = busy.select("key", "repo", "owner", "x", F.sha2(F.col("x.value"), 256).alias("hash"))
    held = busy.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n")).groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n"))
    held = held.withColumn("salts", F.ceil(F.col("n") / HOT).cast("int"))
    hot = held.where("salts > 1").select("hash", F.col("salts").alias("of"))
    salt = F.pmod(F.xxhash64("key", "x"), F.coalesce("of", F.lit(1))).cast("int")
    asked = busy.select("key", "x", "hash").distinct().join(F.broadcast(hot), "hash", "left").withColumn("salt", salt).drop("of")
    told = held.select("hash", "n_repos", "n_owners", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return asked.join(told, ["hash", "salt"]).withColumn("copied", (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS))


def columns_of(docs: DataFrame, id_col: str, text_col: str, repo_cols: tuple[str, ...], owner_cols: tuple[str, ...], keep: list[str]) -> DataFrame:
    """(doc_id, body, repo, owner, kept): an owner is part of its repositories."""
    several = lambda names: F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    kept = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"), several((*owner_cols, *repo_cols)).alias("repo"), several(owner_cols).alias("owner"), kept.alias("kept"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = (), owner_cols: tuple[str, ...] = ("source",), mask: str = "[REDACTED]") -> DataFrame:
    """The rows of docs, all columns as they are but the text, in which mask takes the place of every span.

    Only rows with candidates beyond the base spans meet the corpus-wide counts; other texts aren't shuffled.
    """
    rows = candidates(columns_of(docs, id_col, text_col, repo_cols, owner_cols, docs.columns))
    live = judge(cut(rows.where(F.size("more") > 0).drop("body", "kept"))).where((F.col("x.kind") == "live") & ~F.col("copied")).groupBy("key").agg(F.collect_list("x").alias("live")).withColumnRenamed("key", "of")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    plain = rows.where(F.size("more") == 0).withColumn("live", none)
    asked = rows.where(F.size("more") > 0).join(live, F.col("key").eqNullSafe(F.col("of")), "left").drop("of").withColumn("live", F.coalesce("live", none))
    both = plain.unionByName(asked).withColumn("spans", F.array_sort(F.concat("base", "live")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        between = F.substring(F.col("body"), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, F.lit((1 << 31) - 1))))
    text = F.when(F.size("spans") > 0, text).otherwise(F.col("kept").getField(text_col))
    return both.select(*[text.alias(c) if c == text_col else F.col("kept").getField(c).alias(c) for c in docs.columns])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = (), owner_cols: tuple[str, ...] = ("source",), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: counts by kind, digest of the base spans, all spans, how many of
    the row's values are live-looking or widely copied, and the most owners and repositories
    that hold one of its values (0 without values); then the columns keep.

    The array column span_list holds the spans as structs, for callers that redact.
    """
    rows = cut(candidates(columns_of(docs, id_col, text_col, repo_cols, owner_cols, list(keep))).drop("body"))
    judged = judge(rows)
    copied = F.col("copied")
    per_row = judged.groupBy("key").agg(
        F.collect_list(F.when((F.col("x.kind") == "live") & ~copied, F.col("x"))).alias("live"),
        F.sum(F.when(copied, 0).otherwise(1)).alias("n_live"),
        F.sum(F.when(copied, 1).otherwise(0)).alias("n_copied"),
        F.max("n_owners").alias("n_owners"),
        F.max("n_repos").alias("n_repos"),
    )
    out = rows.drop("more", "repo", "owner").join(per_row.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left")
    spans = F.concat("base", F.coalesce("live", F.expr(f"cast(array() as array<{SPAN}>)")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_copied", "n_owners", "n_repos")],
        F.array_sort(spans).alias("span_list"),
        *[F.col("kept").getField(c).alias(c) for c in keep],
    )
