"""Set-based loads: upserts, dimensions, links and merges, all idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.normalize import digits, statute_parts


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *latest: Column) -> DataFrame:
    """M1: one row for each key, the latest of the new ones before any old one, and was_inserted. Rows that are equally late are in the order of all their columns."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    by = Window.partitionBy(*keys).orderBy(F.desc("__new"), *latest, *old.columns)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one order for both, so that rows are sorted once; old rows come last
    ranked = both.withColumns({"__n": F.row_number().over(by), "was_inserted": F.last("__new").over(every) == 1})
    return ranked.filter("__n = 1").drop("__n", "__new")


def _absent(rows: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys aren't in ``there``; null equals null."""
    named = there.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(named, on, "left_anti")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M2: the old rows and those new ones whose key (null equals null) isn't there; of new rows of one key the first by all their columns."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*").select(*new.columns) if rest else new.distinct()
    return old.unionByName(_absent(fresh, old, keys))


def dimension(known: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """Known rows and the names that are missing, with a hash of the name as key, so that runs agree and keys stay when names are added."""
    fresh = names.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct().join(known.select(name), name, "left_anti")
    return known.unionByName(fresh.select(F.xxhash64(name).alias(key), name))


def bridge(rows: DataFrame, names: DataFrame, name: str, key: str, *keep: str) -> DataFrame:
    """M5, M6: the distinct pairs of ``keep`` and the key of ``name`` in a dimension."""
    return rows.withColumn(name, F.trim(name)).join(names.select(name, key), name).select(*keep, key).distinct()


def taxonomy(rows: DataFrame, *levels: str) -> DataFrame:
    """M4, M8: taxonomy_id, parent_id, name, level_type of every prefix of the level columns; a null or blank level ends a path."""
    clean = rows.select(*_paths(*levels))
    out = None
    for k, level in enumerate(levels):
        parent = F.xxhash64(*levels[:k]) if k else F.lit(None).cast("bigint")
        own = clean.dropna(subset=list(levels[: k + 1])).select(F.xxhash64(*levels[: k + 1]).alias("taxonomy_id"), parent.alias("parent_id"), F.col(level).alias("name"), F.lit(level).alias("level_type")).distinct()
        out = own if out is None else out.union(own)
    return out


def _paths(*levels: str) -> list[Column]:
    """The level columns, trimmed; one after a null or blank one is null."""
    found, before = [], F.lit(True)
    for level in levels:
        own = F.nullif(F.trim(level), F.lit(""))
        before = before & own.isNotNull()
        found.append(F.when(before, own).alias(level))
    return found


def deepest(rows: DataFrame, *levels: str) -> DataFrame:
    """M4: ``rows`` with taxonomy_id of the longest prefix of their levels; null without a first level."""
    named = rows.withColumns({f"__{x}": c for x, c in zip(levels, _paths(*levels), strict=True)})
    ids = [F.when(F.col(f"__{levels[k]}").isNotNull(), F.xxhash64(*[f"__{x}" for x in levels[: k + 1]])) for k in reversed(range(len(levels)))]
    return named.withColumn("taxonomy_id", F.coalesce(*ids)).select(*rows.columns, "taxonomy_id")


def merged_duplicates(rows: DataFrame, key: str, children: DataFrame, foreign: str, *same: str) -> tuple[DataFrame, DataFrame]:
    """M9: of rows that agree on ``same`` (null equals null) the one with the least key, and ``children`` whose foreign keys name those."""
    kept = rows.groupBy(*same).agg(F.min(key).alias("__kept"))
    on = F.lit(True)
    for c in same:
        on = on & rows[c].eqNullSafe(kept[c])
    named = rows.join(kept, on).select(rows[key].alias("__old"), "__kept")
    moved = children.join(named, F.col(foreign) == F.col("__old"), "left").withColumn(foreign, F.coalesce("__kept", foreign)).select(*children.columns)
    return rows.join(named.filter("__old = __kept").select("__kept"), F.col(key) == F.col("__kept"), "left_semi"), moved


def reloaded(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """M7: the children ``new`` and those old ones whose parent has no new ones."""
    return _absent(old, new, [key]).unionByName(new)


def updated(rows: DataFrame, values: DataFrame, key: str, column: str, overwrite: bool = False) -> DataFrame:
    """``rows`` with ``column`` from ``values`` (key, column) where it is null, or with ``overwrite`` wherever there is a value."""
    new = values.groupBy(key).agg(F.min(column).alias("__v"))
    both = ("__v", column) if overwrite else (column, "__v")
    return rows.join(new, key, "left").withColumn(column, F.coalesce(*both)).select(*rows.columns)


def children(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Key, position (from 1) and the fields of each element of an array column of structs; null elements are left out."""
    out = rows.select(key, F.posexplode(column).alias("p", "c")).filter("c is not null")
    return out.select(key, (F.col("p") + 1).alias("position"), "c.*")


def load_counts(results: DataFrame) -> DataFrame:
    """Success, duplicate and failed of results (ok, was_inserted) of a batch, null counting as a failure."""
    ok, fresh = F.coalesce("ok", F.lit(False)), F.coalesce("was_inserted", F.lit(False))
    return results.agg(F.count_if(ok & fresh).alias("success"), F.count_if(ok & ~fresh).alias("duplicate"), F.count_if(~ok).alias("failed"))


def complete_load(cases: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The tables of cases with arrays parties, judges, issues and arguments; all arguments belong to the case's first issue."""
    tables = {name: children(cases, key, name) for name in ("parties", "judges", "issues", "arguments")}
    first = tables["issues"].filter("position = 1").select(key, F.xxhash64(key, F.lit(1)).alias("issue_id"))
    tables["issues"] = tables["issues"].withColumn("issue_id", F.xxhash64(key, "position"))
    tables["arguments"] = tables["arguments"].join(first, key)
    return tables


def cascade(left: DataFrame, key: str, *matches: DataFrame) -> DataFrame:
    """``left`` with target and strategy: of the matches (key, target), the first table that has the key, and its least target."""
    ranked = None
    for k, m in enumerate(matches, 1):
        own = m.select(key, "target", F.lit(k).alias("strategy"))
        ranked = own if ranked is None else ranked.union(own)
    best = ranked.groupBy(key).agg(F.min(F.struct("strategy", "target")).alias("b")).select(key, F.col("b.target").alias("target"), F.col("b.strategy").alias("strategy"))
    return left.join(best, key, "left")


def suffixes(text: Column) -> Column:
    """All ends of a text, so that LIKE '%x' is an equi-join."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.length(text)))


def prefixes(text: Column) -> Column:
    """All beginnings of a text, so that LIKE 'x%' is an equi-join."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, F.lit(1), i))


def containing(rows: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """``rows`` joined with the needles that their text contains, letters' case aside.

    Texts are cut into all parts of the needles' lengths, of which there are few, so it is an equi-join.
    """
    named = needles.withColumn("__n", F.lower(needle)).filter("__n <> ''")
    lengths = sorted(r[0] for r in named.select(F.length("__n")).distinct().collect())
    if not lengths:
        return rows.join(named.drop("__n"), F.lit(False))
    low = F.lower(text)

    def cut(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1)))
        return F.when(F.length(low) >= n, F.transform(places, lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = F.array_distinct(F.flatten(F.array(*[cut(n) for n in lengths])))
    return rows.withColumn("__n", F.explode(parts)).join(named, "__n").drop("__n")


def linked(briefs: DataFrame, cases: DataFrame) -> DataFrame:
    """``briefs`` (brief_id, folder, file_id) with target and strategy: 1 where the folder's digits are those of a case's number, 2 where file_id is a case's id, 3 where a number's digits end with it; null for orphans. Of several cases the least id."""
    number = cases.select("case_id", digits(F.col("case_file_id")).alias("d")).filter("d <> ''")
    one = briefs.select("brief_id", digits(F.col("folder")).alias("d")).join(number, "d").select("brief_id", F.col("case_id").alias("target"))
    two = briefs.join(cases.select("case_id", F.col("case_id").cast("string").alias("file_id")), "file_id").select("brief_id", F.col("case_id").alias("target"))
    ends = number.select("case_id", F.explode(suffixes(F.col("d"))).alias("file_id"))
    three = briefs.join(ends, "file_id").select("brief_id", F.col("case_id").alias("target"))
    return cascade(briefs, "brief_id", one, two, three)


def resolved_statutes(citations: DataFrame, statutes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``citations`` (id, citation) with statute_id and strategy, and the statutes (statute_id, title, section, subsection) with those that had to be made.

    1: title, section and the citation's subsection, or a statute without one; 2: title and section;
    3: a statute whose section begins with the citation's; 4: a new one, its id a hash of its parts.
    Of several statutes the least id; citations that aren't statutes have none.
    """
    # A statute counts only as the least of its kind, so that a citation meets one row of each kind and not all statutes of its title and section.
    own = statutes.select("statute_id", "title", "section", "subsection")
    exact = own.filter("subsection is not null").groupBy("title", "section", F.col("subsection").alias("sub")).agg(F.min("statute_id").alias("__sub"))
    same = own.groupBy("title", "section").agg(F.min("statute_id").alias("__same"), F.min(F.when(F.col("subsection").isNull(), F.col("statute_id"))).alias("__whole"))
    begins = same.select("title", F.explode(prefixes(F.col("section"))).alias("section"), "__same").groupBy("title", "section").agg(F.min("__same").alias("__begins"))
    # Each distinct text is looked up once.
    parts = statute_parts(F.col("citation"))
    wanted = citations.select("citation").distinct().select("citation", parts["title"].alias("title"), parts["section"].alias("section"), parts["subsection"].alias("sub")).filter("title is not null and section is not null")
    met = wanted.join(exact, ["title", "section", "sub"], "left").join(same, ["title", "section"], "left").join(begins, ["title", "section"], "left")
    one = F.when(F.col("sub").isNotNull(), F.least("__sub", "__whole"))  # null only if both are
    made = F.xxhash64("title", "section", F.coalesce("sub", F.lit("")))
    strategy = F.when(one.isNotNull(), 1).when(F.col("__same").isNotNull(), 2).when(F.col("__begins").isNotNull(), 3).otherwise(4)
    named = met.select("citation", "title", "section", "sub", F.coalesce(one, "__same", "__begins", made).alias("statute_id"), strategy.alias("strategy"))
    new = named.filter("strategy = 4").select("statute_id", "title", "section", F.col("sub").alias("subsection")).distinct()
    return citations.join(named.select("citation", "statute_id", "strategy"), "citation", "left").select(*citations.columns, "statute_id", "strategy"), own.unionByName(new)


def chained(briefs: DataFrame) -> DataFrame:
    """``briefs`` (brief_id, case_file_id, brief_type, created_at) with responds_to and sequence: a response follows the case's latest opening brief, a reply its latest response; cases are compared by the digits of their number."""
    own = briefs.withColumn("__d", digits(F.col("case_file_id")))
    latest = own.groupBy("__d", F.col("brief_type").alias("__t")).agg(F.max_by("brief_id", F.struct("created_at", "brief_id")).alias("responds_to"))
    before = F.when(F.col("brief_type") == "Response", "Opening").when(F.col("brief_type") == "Reply", "Response")
    met = own.withColumn("__t", before).join(latest, ["__d", "__t"], "left")
    sequence = F.when(F.col("responds_to").isNull(), 1).when(F.col("brief_type") == "Response", 2).otherwise(3)
    return met.select(*briefs.columns, "responds_to", sequence.alias("sequence"))


def predecessor(rows: DataFrame, earlier: DataFrame, key: str, at: str, id_col: str) -> DataFrame:
    """``rows`` with responds_to: the id of the latest of ``earlier`` of the same key that is before them; of one time the highest id.

    One pass over each key in order of time, in which rows come before what is as late as they are.
    """
    own = rows.withColumn("__row", F.lit(True)).withColumn("__id", F.lit(None).cast(earlier.schema[id_col].dataType))
    prior = earlier.select(key, at, F.lit(False).alias("__row"), F.col(id_col).alias("__id"))
    order = Window.partitionBy(key).orderBy(F.col(at).asc_nulls_last(), F.desc("__row"), "__id").rowsBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(prior, allowMissingColumns=True).withColumn("responds_to", F.when(F.col(at).isNotNull() & F.col(key).isNotNull(), F.last("__id", ignorenulls=True).over(order)))
    return both.filter("__row").select(*rows.columns, "responds_to")


def merged(columns: list[str], **sources: DataFrame) -> DataFrame:
    """Rows by id with each column from the first source that has it, and ``provenance``, a map of where it came from."""
    names = list(sources)
    out = None
    for s, rows in sources.items():
        own = rows.select("id", *[F.col(c).alias(f"{s}__{c}") for c in columns])
        out = own if out is None else out.join(own, "id", "full_outer")
    picked = [F.coalesce(*[F.col(f"{s}__{c}") for s in names]).alias(c) for c in columns]
    origin = [x for c in columns for x in (F.lit(c), F.coalesce(*[F.when(F.col(f"{s}__{c}").isNotNull(), F.lit(s)) for s in names], F.lit("none")))]
    return out.select("id", *picked, F.create_map(*origin).alias("provenance"))
