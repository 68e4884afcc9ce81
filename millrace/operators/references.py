"""Fix references in mails: extraction, merging, resolution against commits, selection, and emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schemas as S
from millrace.functions import text as X

FROM_LINE, FROM_LINK = "fixed-line", "commit-url"


def extracted(mails: DataFrame, key: str, body: str = "body", host: str = X.COMMIT_HOST) -> DataFrame:
    """(``key``, kind, pos, version, hash, source): every reference of every mail.

    kind orders the three ways of naming a commit: 0 lines, 1 short links, 2 links with an id.
    """
    short, by_id = X.linked_hashes(F.col(body), host)
    as_rows = lambda hashes, kind: F.transform(
        hashes, lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.lit(None).cast("string").alias("version"), F.lower(h).alias("hash"), F.lit(FROM_LINK).alias("source"))
    )
    of_lines = F.transform(
        X.fixed_lines(F.col(body)),
        lambda p, i: F.struct(F.lit(0).alias("kind"), i.alias("pos"), p["version"].alias("version"), F.lower(p["hash"]).alias("hash"), F.lit(FROM_LINE).alias("source")),
    )
    every = F.concat(of_lines, as_rows(short, 1), as_rows(by_id, 2))
    return mails.select(F.col(f"`{key}`"), F.explode(every).alias("r")).select(f"`{key}`", "r.kind", "r.pos", "r.version", "r.hash", "r.source")


def merged(references: DataFrame, key: str) -> DataFrame:
    """(``key``, fix_idx, reported_hash, versions, sources): one row per mail and hash, in order of first mention.

    Versions and sources are distinct, in order; spellings of different length stay apart.
    """
    ordered = lambda field: F.array_distinct(
        F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", field))), lambda x: x[field]))
    )
    grouped = references.groupBy(F.col(f"`{key}`"), F.col("hash").alias("reported_hash")).agg(
        F.min(F.struct("kind", "pos")).alias("first"), ordered("version").alias("versions"), ordered("source").alias("sources")
    )
    place = F.row_number().over(Window.partitionBy(f"`{key}`").orderBy("first")) - 1
    return grouped.withColumn("fix_idx", place).drop("first")


def merged_in_row(body: Column, host: str = X.COMMIT_HOST) -> Column:
    """The merged references of one body as an array, without a shuffle.

    Elements: reported_hash, versions, sources, in order of first mention.
    """
    short, by_id = X.linked_hashes(body, host)
    pairs = X.fixed_lines(body)
    linked = F.transform(F.concat(short, by_id), F.lower)
    hashes = F.array_distinct(F.concat(F.transform(pairs, lambda p: F.lower(p["hash"])), linked))

    def one(h: Column) -> Column:
        own = F.filter(pairs, lambda p: F.lower(p["hash"]) == h)
        return F.struct(
            h.alias("reported_hash"),
            F.array_distinct(F.transform(own, lambda p: p["version"])).alias("versions"),
            F.array_compact(F.array(F.when(F.size(own) > 0, F.lit(FROM_LINE)), F.when(F.array_contains(linked, h), F.lit(FROM_LINK)))).alias("sources"),
        )

    return F.transform(hashes, one)


def resolve(references: DataFrame, ref: str, commits: DataFrame, hash_: str = "hash") -> DataFrame:
    """(``ref`` in lower case, canonical_hash) of the distinct references that name exactly one commit.

    A reference names the commits whose hash begins with it. Distinct references are looked up once:
    whole hashes by equality, longer prefixes by their first seven digits, shorter ones by four, each
    with the rest compared behind the equality. Ambiguous references name none.
    """
    known = commits.select(F.lower(F.col(f"`{hash_}`")).alias("full")).where(X.is_hash(F.col("full"))).distinct()
    wanted = references.select(F.lower(F.col(f"`{ref}`")).alias(ref)).where(X.is_hash(F.col(ref))).distinct()
    exact = wanted.join(known, F.col(ref) == F.col("full")).select(ref, "full")
    rest = wanted.join(known, F.col(ref) == F.col("full"), "left_anti")

    def by_prefix(part: DataFrame, n: int) -> DataFrame:
        keyed = part.withColumn("__p", F.left(ref, F.lit(n)))
        other = known.withColumn("__p", F.left("full", F.lit(n)))
        return keyed.join(other, "__p").where(F.col("full").startswith(F.col(ref))).select(ref, "full")

    found = by_prefix(rest.where(F.length(ref) >= 7), 7).unionAll(by_prefix(rest.where(F.length(ref) < 7), 4))
    alone = found.groupBy(ref).agg(F.min("full").alias("full"), F.max("full").alias("other")).where("full = other").select(ref, "full")
    return exact.unionAll(alone).withColumnRenamed("full", "canonical_hash")


def attach(fixes: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """``fixes`` with canonical_hash ('' if unresolved) and in_linux_repo; no resolution leaves all unresolved."""
    if resolved is None:
        return fixes.withColumn("canonical_hash", F.lit("")).withColumn("in_linux_repo", F.lit(False))
    looked_up = resolved.select(F.col("reported_hash").alias("__r"), "canonical_hash")
    joined = fixes.join(looked_up, F.lower("reported_hash") == F.col("__r"), "left").drop("__r")
    return joined.withColumn("canonical_hash", X.given(F.col("canonical_hash"))).withColumn("in_linux_repo", F.col("canonical_hash") != "")


def select_fixes(mails: DataFrame, fixes: DataFrame, key: str, order: list[str], prefer_known: bool = True, fall_back: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mails with status and reason, fixes with selected and emitted).

    ``mails`` has ``key``, cve_ids and the columns of ``order``; ``fixes`` is the result of ``attach``. Mails without
    identifiers are ignored before any other rule; those without fixes come next. With ``prefer_known`` only
    fixes in the repository count; if a mail has none, ``fall_back`` takes all of them. Of all selected fixes
    with one output hash (canonical, else reported) the first, by mail order and place, is emitted.
    """
    per_mail = fixes.groupBy(f"`{key}`").agg(F.count(F.lit(1)).alias("__n"), F.bool_or("in_linux_repo").alias("__known"))
    state = mails.join(per_mail, key, "left")
    no_ids = F.coalesce(F.size("cve_ids"), F.lit(0)) < 1
    no_fix = F.coalesce("__n", F.lit(0)) == 0
    known = F.coalesce("__known", F.lit(False))
    if prefer_known:
        status = F.when(no_ids, S.IGNORED).when(no_fix, S.NO_FIXES).when(known | F.lit(fall_back), S.SELECTED).otherwise(S.UNRESOLVED)
        reason = F.when(no_ids, S.NO_CVE_ID).when(no_fix, S.NO_FIX_REFERENCE).when(known, S.IN_REPOSITORY).otherwise(S.FELL_BACK if fall_back else S.NOT_IN_REPOSITORY)
    else:
        status = F.when(no_ids, S.IGNORED).when(no_fix, S.NO_FIXES).otherwise(S.SELECTED)
        reason = F.when(no_ids, S.NO_CVE_ID).when(no_fix, S.NO_FIX_REFERENCE).otherwise(S.ALL_FIXES)
    decided = state.withColumn("status", status).withColumn("reason", reason).withColumn("__known", known)
    joined = fixes.join(decided.select(key, "status", "__known", *[F.col(o).alias(f"__o_{o}") for o in order]), key)
    takes_all = ~F.col("__known") if prefer_known and fall_back else F.lit(not prefer_known)
    chosen = (F.col("status") == S.SELECTED) & (F.col("in_linux_repo") | takes_all)
    marked = joined.withColumn("selected", chosen).withColumn("output_hash", F.when(F.col("canonical_hash") != "", F.col("canonical_hash")).otherwise(F.col("reported_hash")))
    place = F.struct(*[F.col(f"__o_{o}") for o in order], F.col("fix_idx"))
    marked = marked.withColumn("__place", place)
    # the first place of each output hash; partial aggregation keeps hot hashes to one row a task
    first = marked.where("selected").groupBy("output_hash").agg(F.min("__place").alias("__first")).withColumnRenamed("output_hash", "__oh")
    emitted = marked.join(first, F.col("output_hash") == F.col("__oh"), "left").withColumn(
        "emitted", F.col("selected") & F.coalesce(F.col("__place") == F.col("__first"), F.lit(False))
    )
    gone = [c for c in emitted.columns if c.startswith("__")]
    return decided.drop("__n", "__known"), emitted.drop(*gone, "status")


def audit(mails: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """One row per mail with its fixes as an array of structs in order, empty where there are none."""
    cols = ("reported_hash", "versions", "sources", "in_linux_repo", "canonical_hash", "selected", "emitted")
    each = F.array_sort(F.collect_list(F.struct("fix_idx", F.struct(*cols).alias("fix"))))
    nested = fixes.groupBy(f"`{key}`").agg(F.transform(each, lambda x: x["fix"]).cast(f"array<{S.FIX}>").alias("fixes"))
    none = F.array().cast(f"array<{S.FIX}>")
    return mails.join(nested, key, "left").withColumn("fixes", F.coalesce("fixes", none))
