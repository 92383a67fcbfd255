"""Entity resolution steps above single names: learned names, adjudication, alias tables, canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import names as nm
from quillspark.operators import series as s
from quillspark.sources.tables import require_empty, require_subset


def given_names(names: DataFrame, name: str, follow: int = lx.GIVEN_FOLLOW, legal: float = lx.GIVEN_LEGAL) -> DataFrame:
    """Words that follow many different first words in names that rarely have a legal form."""
    t = names.select(F.split(nm.words_of(F.col(name)), " ").alias("t"))
    rest = F.array_distinct(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))))
    each = t.select(F.element_at("t", 1).alias("first"), nm.has_legal(F.col("t")).cast("int").alias("legal"), F.explode(rest).alias("word"))
    return each.groupBy("word").agg(F.countDistinct("first").alias("follow"), F.avg("legal").alias("legal")).filter((F.col("follow") >= follow) & (F.col("legal") < legal))


def persons(names: DataFrame, name: str, given: DataFrame) -> DataFrame:
    """Names of persons: two to four words, none legal or of an institution, all but the first given names or initials.

    The learned words are joined, not collected: a name is a person if all its later words find one.
    """
    t = names.select(name, F.split(nm.words_of(F.col(name)), " ").alias("t")).distinct()
    t = t.filter(F.size("t").between(2, 4) & ~nm.has_legal(F.col("t")) & ~F.arrays_overlap("t", F.array(*map(F.lit, lx.INSTITUTIONS))))
    each = t.select(name, F.element_at("t", 1).alias("surname"), F.explode(F.slice("t", F.lit(2), F.size("t") - 1)).alias("word"))
    known = each.join(given.select("word", F.lit(True).alias("known")), "word", "left").withColumn("ok", F.coalesce("known", F.col("word").rlike("^[A-Z]$")))
    return known.groupBy(name, "surname").agg(F.bool_and("ok").alias("ok")).filter("ok").drop("ok")


def surnames(people: DataFrame, least: int = lx.SURNAME_MIN) -> DataFrame:
    """First words of many persons."""
    return people.groupBy("surname").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def adjudicate(review: DataFrame, judged: DataFrame, include: DataFrame, least: int = 100) -> DataFrame:
    """Decisions on names under review with enough publications and none yet: INCLUDE if listed, else EXCLUDE.

    A listed name that isn't under review is an error. All tables have ticker and assignee.
    """
    keys = ["ticker", "assignee"]
    require_subset(include, review, keys, "listed but not under review")
    open_ = review.filter(F.col("n") >= least).join(judged.select(*keys), keys, "left_anti")
    listed = include.select(*keys, F.lit("INCLUDE").alias("d")).distinct()
    return open_.join(listed, keys, "left").select(*keys, "n", F.coalesce("d", F.lit("EXCLUDE")).alias("decision"))


def reason(core: Column, name: Column, head_firms: Column, functional: list[str]) -> Column:
    """Why a name under review is or isn't taken for the firm: whose its first word is, whether the prefix fits, and what follows."""
    fits = F.startswith(F.concat(name, F.lit(" ")), F.concat(core, F.lit(" ")))
    rest = F.trim(F.substr(name, F.length(core) + 1))
    known = F.forall(F.split(rest, " "), lambda w: F.array_contains(F.array(*map(F.lit, functional)), w))
    return (
        F.when((head_firms > 1) & fits, "head of several firms, whole prefix fits")
        .when(head_firms > 1, "head of several firms, second word differs")
        .when(~fits, "own head, not the whole prefix")
        .when(rest == "", "same core")
        .when(known, F.concat(F.lit("own head and functional words: "), rest))
        .otherwise(F.concat(F.lit("own head, but further words: "), rest))
    )


def assemble_aliases(automatic: DataFrame, manual: DataFrame, curated: DataFrame, vetoed: DataFrame) -> DataFrame:
    """One row per ticker and assignee from three sources (curated over manual over automatic), vetoed pairs left out."""
    keys = ["ticker", "assignee"]
    source = lambda df, tier, prio: df.select(*keys, tier.alias("tier"), F.lit(prio).alias("prio"))
    auto = source(automatic, F.when(F.col("tier") == "T1_EXACT", "parent").otherwise("subsidiary"), 2).join(vetoed.select(*keys), keys, "left_anti")
    every = auto.unionByName(source(manual, F.lit("parent"), 1)).unionByName(source(curated, F.lit("parent"), 0))
    return s.first_match(every, keys, F.col("prio"), F.col("tier")).drop("prio")


def split_at_acquisition(aliases: DataFrame, prefix: str, cut: Column, before: str, after: str) -> DataFrame:
    """Names with the prefix belong to one owner up to the day before the cut and to the other from then on."""
    hit = F.col("assignee").startswith(prefix) & F.col("ticker").isin(before, after)
    part = lambda t, a, b: F.struct(F.lit(t).alias("ticker"), a.cast("date").alias("a"), b.cast("date").alias("b"))
    none = F.lit(None)
    parts = F.when(hit, F.array(part(before, none, F.date_sub(cut, 1)), part(after, cut, none))).otherwise(F.array(F.struct(F.col("ticker"), none.cast("date").alias("a"), none.cast("date").alias("b"))))
    return aliases.select("assignee", "tier", F.inline(parts)).distinct()


def canonical_keys(roster: DataFrame) -> DataFrame:
    """ticker to permco from a roster with arrays of all tickers; an ambiguous ticker is an error."""
    pairs = roster.select("permco", F.explode("all_tickers").alias("ticker")).distinct()
    require_empty(pairs.groupBy("ticker").agg(F.count("*").alias("n")).filter("n > 1"), "tickers of several firms")
    return pairs
