"""Annotation by a dictionary: the longest entry at each place of a run of characters, from the left, by joins.

Only what a run holds decides its matches, so each different run is cut once, however often it comes. A run is cut at every place to
every length that the dictionary has, and the cuts are joined with the dictionary on equality: both sides may be of any size, and no
dictionary goes through the driver or into an expression. The greedy choice from the left then follows the matches: where no match
reaches over a place, a new island of overlapping matches begins, and islands, which are short, are folded one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Fixed: characters that readings are looked up for, as the inside of a character class.
IDEOGRAPHS = "一-鿿"
TOKENS = "array<struct<text:string,reading:string>>"


def pieces(text: Column, chars: str = IDEOGRAPHS) -> Column:
    """A text cut into runs of these characters and what lies between; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{chars}]+|[^{chars}]+)"), 1)


def run_matches(runs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, place from 0, base, reading): the matches of runs (id, run) that a cursor takes which tries the longest entry first and else
    goes on by one character. lexicon: base, reading; of several readings of a base the smallest counts."""
    entries = lexicon.filter("base <> ''").groupBy("base").agg(F.min("reading").alias("reading"))
    lengths = entries.agg(F.collect_set(F.length("base")).alias("lengths"))
    places = runs.withColumn("lengths", lengths.scalar()).select("id", "run", "lengths", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("place"))
    cuts = places.select("id", "place", F.explode(F.filter("lengths", lambda n: n + F.col("place") <= F.length("run"))).alias("n"), "run")
    cuts = cuts.select("id", "place", "n", F.substring("run", F.col("place") + 1, F.col("n")).alias("base"))
    best = F.max_by(F.struct("base", "reading"), "n")
    hits = cuts.join(entries, "base").groupBy("id", "place").agg(F.max("n").alias("n"), best.alias("entry"))
    order = W.partitionBy("id").orderBy("place")
    reached = F.max(F.col("place") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.coalesce(F.col("place") >= reached, F.lit(True)).cast("int")
    islands = hits.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
    row = F.struct("place", "n", F.col("entry.base").alias("base"), F.col("entry.reading").alias("reading"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<place:int,n:int,base:string,reading:string>>").alias("out"))
    step = lambda a, h: F.when(h["place"] >= a["next"], F.struct((h["place"] + h["n"]).alias("next"), F.array_append(a["out"], h).alias("out"))).otherwise(a)
    taken = islands.groupBy("id", "island").agg(F.aggregate(F.sort_array(F.collect_list(row)), start, step, lambda a: a["out"]).alias("out"))
    return taken.select("id", F.inline("out")).select("id", "place", "base", "reading")


def different_runs(rows: DataFrame, text: str, chars: str = IDEOGRAPHS) -> DataFrame:
    """(id, run): each run of these characters that any row of rows has, once, written to the shared folder with a number."""
    runs = rows.select(F.explode(pieces(F.col(text), chars)).alias("run")).filter(F.col("run").rlike(f"^[{chars}]")).distinct()
    return written(runs.withColumn("id", F.monotonically_increasing_id()), "runs")


def run_tokens(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """(run, tokens): a run with any match as tokens (text, reading); plain stretches have no reading."""
    found = matches.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "base", "reading"))).alias("m"))
    end = lambda m: m["place"] + F.length(m["base"])
    plain = lambda a, b: F.struct(F.substring("run", a + 1, b - a).alias("text"), F.lit(None).cast("string").alias("reading"))
    own = lambda m, i: F.array(plain(F.when(i == 0, F.lit(0)).otherwise(end(F.get("m", i - 1))), m["place"]), F.struct(m["base"].alias("text"), m["reading"].alias("reading")))
    tail = plain(end(F.element_at("m", -1)), F.length("run"))
    tokens = F.filter(F.concat(F.flatten(F.transform("m", own)), F.array(tail)), lambda t: t["text"] != "")
    return runs.join(found, "id").select("run", tokens.cast(TOKENS).alias("tokens"))


def annotate(rows: DataFrame, keys: list[str], text: str, lexicon: DataFrame, chars: str = IDEOGRAPHS) -> DataFrame:
    """keys, tokens: each text as tokens (text, reading): an entry with its reading, or all that stands between two entries, without one.

    Entries are found inside runs of `chars` alone, so none reaches across other characters. A text without entries is one token, an
    empty or null one has none. keys tell rows apart.
    """
    runs = different_runs(rows, text, chars)
    known = run_tokens(runs, run_matches(runs, lexicon))
    parts = rows.select(*keys, F.posexplode(pieces(F.col(text), chars)).alias("_piece", "run"))
    whole = F.array(F.struct(F.col("run").alias("text"), F.lit(None).cast("string").alias("reading")))
    atoms = parts.join(known, "run", "left").select(*keys, "_piece", F.posexplode(F.coalesce("tokens", whole)).alias("_place", "_token"))
    hit = F.col("_token.reading").isNotNull()
    seen = F.sum(hit.cast("int")).over(W.partitionBy(*keys).orderBy("_piece", "_place").rowsBetween(W.unboundedPreceding, 0))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_piece", "_place", F.col("_token.text").alias("text")))), lambda a: a["text"]), "")
    tokens = atoms.withColumns({"_seen": seen, "_plain": ~hit}).groupBy(*keys, "_seen", "_plain").agg(joined.alias("text"), F.max("_token.reading").alias("reading"))
    out = tokens.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_seen", "_plain", "text", "reading"))), lambda t: F.struct(t["text"].alias("text"), t["reading"].alias("reading"))).alias("tokens"))
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.select(*keys).join(out.withColumnsRenamed(names), same, "left").select(*keys, F.coalesce("tokens", F.array().cast(TOKENS)).alias("tokens"))
