"""Printed labels placed on the codes of a taxonomy, and printed figures found among cells: equi joins on what each can match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: words that begin what a label is qualified by, not what it names.
QUALIFIED = r"\b(?:including|inclusive of|incl|net of|excluding|after adjusting)\b"
LONGEST = 12  # words of an alias at most


def plain(label: Column) -> Column:
    """A label's words in lower case with one blank between; numbering in front and units in brackets go."""
    bare = F.regexp_replace(F.lower(label), r"^\s*(?:\(?[0-9]+(?:\.[0-9]+)*[.)]?|\(?[a-z]\))\s+|\((?:rs|in|inr|mu|crore|lakh)[^)]*\)", " ")
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def place_labels(labels: DataFrame, aliases: DataFrame, refusals: DataFrame) -> DataFrame:
    """``id, code, alias, how`` of the labels ``id, label, unit`` that name one code of ``aliases`` (alias, code, unit).

    A label that is an alias names its code (``exact``); an alias of several codes names the one of the label's unit, or
    nothing. Other labels name the code of the longest alias, of four letters or more, that their words before a
    qualification contain (``contains``), unless the label holds a phrase that ``refusals`` (code, phrase) keeps from it.
    Runs of words meet aliases by equality, so the taxonomy may be of any size.
    """
    known = aliases.select(plain(F.col("alias")).alias("alias"), "code", F.col("unit").alias("_unit")).distinct()
    norm = labels.select("id", "unit", plain(F.col("label")).alias("norm"))
    head = F.trim(F.element_at(F.split("norm", QUALIFIED), 1))
    own = F.filter(F.split(head, " "), lambda w: w != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(own))), lambda n: F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.array_join(F.slice(own, i, n), " "))))
    runs = F.when(F.size(own) > 0, F.filter(F.array_distinct(runs), lambda r: F.length(r) >= 4)).otherwise(F.array().cast("array<string>"))
    asked = norm.where("norm <> ''").select("id", "unit", "norm", F.explode(F.array_distinct(F.array_append(runs, F.col("norm")))).alias("alias"))
    met = asked.join(known, "alias")
    named = met.groupBy("id", "norm", "alias").agg(F.count_distinct("code").alias("n"), F.min("code").alias("any"), F.count_distinct(F.when(F.col("unit") == F.col("_unit"), F.col("code"))).alias("fits"), F.min(F.when(F.col("unit") == F.col("_unit"), F.col("code"))).alias("fit"))
    named = named.withColumn("exact", F.col("alias") == F.col("norm")).withColumn("code", F.when(F.col("n") == 1, F.col("any")).when(F.col("fits") == 1, F.col("fit")))
    kept = refusals.select(F.col("code").alias("_code"), plain(F.col("phrase")).alias("_phrase"))
    refused = named.join(kept, (F.col("code") == F.col("_code")) & F.contains(F.concat(F.lit(" "), "norm", F.lit(" ")), F.concat(F.lit(" "), F.col("_phrase"), F.lit(" "))), "left_semi").where("not exact")
    left = named.where("exact or code is not null").join(refused.select("id", "alias"), ["id", "alias"], "left_anti")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("exact").desc(), F.length("alias").desc(), "alias"))
    best = left.withColumn("_place", first).where("_place = 1 and code is not null")
    return best.select("id", "code", "alias", F.when(F.col("exact"), "exact").otherwise("contains").alias("how"))


def trace_printed(printed: DataFrame, cells: DataFrame, digits: int = 4) -> DataFrame:
    """``id, result, cells`` of figures ``id, value (decimal), places, percent`` among ``cells`` (value): the least rank of

    traced (equal at the printed places, a percentage also as a fraction), near (one unit of the last place off),
    opposite (equal with the other sign) and untraced; figures of fewer than ``digits`` digits are uninformative. Figures
    and cells meet by places and whole units of the last one; ``cells`` counts the ones of the best rank.
    """
    unit = lambda value, places: F.round(value.cast("decimal(38,10)") * F.pow(F.lit(10), places).cast("decimal(20,0)")).cast("decimal(38,0)")
    size = F.length(F.abs(unit(F.col("value"), F.col("places"))).cast("string"))
    asked = printed.withColumn("_short", size < digits)
    form = lambda value, places: F.struct(value.cast("decimal(38,10)").alias("v"), places.cast("int").alias("p"))
    forms = asked.where("not _short").select("id", F.explode(F.when(F.col("percent"), F.array(form(F.col("value"), F.col("places")), form(F.col("value") / 100, F.col("places") + 2))).otherwise(F.array(form(F.col("value"), F.col("places"))))).alias("f"))
    forms = forms.select("id", F.col("f.p").alias("p"), unit(F.col("f.v"), F.col("f.p")).alias("u"))
    tries = F.explode(F.array(*[F.struct(F.lit(rank).alias("rank"), at.alias("at")) for rank, at in ((1, F.col("u")), (2, F.col("u") - 1), (2, F.col("u") + 1), (3, -F.col("u")))]))
    probes = forms.select("id", "p", tries.alias("t")).select("id", "p", "t.rank", F.col("t.at").cast("decimal(38,0)").alias("at"))
    used = forms.select("p").distinct()  # a row for each number of places
    there = cells.groupBy("value").count().crossJoin(F.broadcast(used)).select("p", unit(F.col("value"), F.col("p")).alias("at"), "count").groupBy("p", "at").agg(F.sum("count").alias("cells"))
    found = probes.join(there, ["p", "at"]).groupBy("id", "rank").agg(F.sum("cells").alias("cells"))
    best = found.groupBy("id").agg(F.min("rank").alias("rank"), F.min_by("cells", "rank").alias("cells"))
    result = F.when(F.col("_short"), "uninformative").when(F.col("rank") == 1, "traced").when(F.col("rank") == 2, "near").when(F.col("rank") == 3, "opposite").otherwise("untraced")
    return asked.join(best, "id", "left").select("id", result.alias("result"), F.coalesce("cells", F.lit(0)).cast("long").alias("cells"))
