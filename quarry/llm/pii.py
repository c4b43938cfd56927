"""Problem 8: personal data found by bootstrapped contextual extraction, and replaced by typed placeholders.

Candidate mentions carry an instance (a given name, the shape of a number, a street) and the lexical patterns they
stand in. Seeds are certain by themselves: a name that an e-mail address beside it spells, an international
telephone number, a public format of identity numbers, a street of a known kind. Seeds induce patterns: Spark
scores each pattern by the share of its mentions whose instance is known, then each instance by the scores of the
patterns it stands in, and so on for some rounds over the aggregated graph of instances and patterns, which is
far smaller than the texts. Confident instances and patterns then decide on all mentions, seen before or not; an
instance that is not known counts where a confident pattern with a word in it holds at least half of its mentions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.piiscan import scan
from quarry.plans.lineage import cut_lineage
from quarry.session import spread

#: Rounds of the scoring; score from which an instance is known, and that from which a pattern is confident.
ROUNDS = 3
KNOWN = 0.5
CONFIDENT = 0.8
#: Weight of doubt in a pattern's score, in mentions.
DOUBT = 1.0
#: What each family of mentions can be.
LABELS = {"name": ["name"], "number": ["phone", "id_number"], "address": ["address"]}

_MENTION = (
    "family string, grp int, start int, stop int, long_stop int, instance string, middle string, tail string, long_tail string, "
    "take_long boolean, contexts array<string>, seed string"
)


def mentions(docs: DataFrame) -> DataFrame:
    """One row per candidate mention in ``doc_id, text``: where it is, its instance, patterns and seed label.

    Whole texts are read. Rows of null id or of null or empty text have no mentions.
    """
    columns = [c.split()[0] for c in _MENTION.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, ids, values, longs = [], [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                for row in scan(text):
                    out.append(row)
                    ids.append(doc_id)
                    values.append(text[row[2] : row[3]])
                    longs.append(text[row[2] : row[4]] if row[4] else None)
            frame = pd.DataFrame(out, columns=columns)
            frame["long_stop"] = frame["long_stop"].astype("Int32")
            frame["take_long"] = frame["take_long"].astype("boolean")
            frame.insert(0, "doc_id", pd.Series(ids, dtype="int64"))
            frame["value"], frame["long_value"] = pd.Series(values, dtype=object), pd.Series(longs, dtype=object)
            yield frame

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    return spread(source).mapInPandas(read, f"doc_id bigint, {_MENTION}, value string, long_value string")


def _labelled(found: DataFrame) -> DataFrame:
    """``found`` of the families that are learnt, once per label it can have."""
    labels = F.array()
    for family, names in LABELS.items():
        labels = F.when(F.col("family") == family, F.array(*map(F.lit, names))).otherwise(labels)
    return found.withColumn("label", F.explode(labels))


def learn(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of instances, ``label, instance, score``, and of patterns, ``label, pattern, p_score, p_known``.

    ``p_known`` is the number of known instances of a pattern. Only aggregated counts are iterated over.
    """
    seen = _labelled(found.where(F.col("family") != "email"))
    edges = cut_lineage(
        seen.select("label", "instance", F.explode("contexts").alias("pattern"), (F.col("seed") == F.col("label")).alias("is_seed"))
        .groupBy("label", "instance", "pattern")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("is_seed").cast("long"), F.lit(0))).alias("seeds"))
    )
    # a name is as certain as the share of its mentions that are spelt by an address, other seeds are certain
    seeded = edges.groupBy("label", "instance").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"))
    names = F.col("label") == "name"
    prior = F.when(F.col("seeds") == 0, 0.0).when(names, F.when(F.col("seeds") >= 0.1 * F.col("n"), 1.0).otherwise(0.0)).otherwise(1.0)
    scores = cut_lineage(seeded.select("label", "instance", prior.alias("prior"), prior.alias("score")))
    # patterns with one known instance only say nothing about others
    worth = F.when(F.col("p_known") >= 2, F.col("p_score")).otherwise(0.0)
    for _ in range(rounds):
        # each step is cut: a plan of several joins costs the driver more than the steps one by one
        patterns = cut_lineage(
            edges.join(scores, ["label", "instance"])
            .groupBy("label", "pattern")
            .agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + DOUBT)).alias("p_score"), F.count_if(F.col("score") >= KNOWN).alias("p_known"))
        )
        learnt = cut_lineage(edges.join(patterns, ["label", "pattern"]).groupBy("label", "instance").agg((F.sum(F.col("n") * worth) / F.sum("n")).alias("learnt")))
        scores = cut_lineage(
            learnt.join(scores.select("label", "instance", "prior"), ["label", "instance"])
            .select("label", "instance", "prior", F.greatest("prior", "learnt").alias("score"))
        )
    return scores.select("label", "instance", "score"), patterns


def _vouched(found: DataFrame, confident: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` of unknown instances in a confident pattern, with ``label, p_score``.

    Against look-alikes, patterns of layout alone (no word) don't count, nor do instances that stand elsewhere in
    more than half of their mentions.
    """
    mention = ["doc_id", "family", "start", "stop", "label", "instance"]
    seen = _labelled(found.where((F.col("family") != "email") & ~F.col("instance").endswith(".")))
    worded = confident.where(F.col("pattern").rlike(r"\p{L}"))
    held = cut_lineage(
        seen.select(*mention, F.explode("contexts").alias("pattern"))
        .join(worded, ["label", "pattern"])
        .join(known, ["label", "instance"], "left_anti")
        .groupBy(*mention)
        .agg(F.max("p_score").alias("p_score"))
    )
    # the other mentions count only of instances that are held somewhere
    counted = held.groupBy("label", "instance").agg(F.count(F.lit(1)).alias("n_held"))
    usual = cut_lineage(
        seen.select("label", "instance", "doc_id", "start", "stop")
        .join(counted, ["label", "instance"])
        .groupBy("label", "instance", "n_held")
        .agg(F.countDistinct("doc_id", "start", "stop").alias("n"))
        .where(2 * F.col("n_held") >= F.col("n"))
    )
    return cut_lineage(found.join(held.join(usual, ["label", "instance"], "left_semi"), ["doc_id", "family", "start", "stop", "instance"]))


def _clear_of(added: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``added`` that overlap none of ``kept`` in their text."""
    taken = kept.select(F.col("doc_id").alias("__doc"), F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    return added.join(taken, (F.col("doc_id") == F.col("__doc")) & (F.col("start") < F.col("__stop")) & (F.col("__start") < F.col("stop")), "left_anti")



def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, pii_type, start, stop, value`` of every piece of personal data in ``doc_id, text``.

    Positions count code points from 0; ``value`` is the text between them. Pieces of one type don't overlap.
    """
    found = cut_lineage(mentions(docs))
    scores, patterns = learn(found, rounds)
    known = cut_lineage(scores.where(F.col("score") >= KNOWN))
    confident = cut_lineage(patterns.where((F.col("p_score") >= CONFIDENT) & (F.col("p_known") >= 2)).select("label", "pattern", F.col("p_score")))
    vouched = _vouched(found, confident, known)

    emails = found.where(F.col("family") == "email").select("doc_id", F.lit("email").alias("pii_type"), "start", "stop", "value")

    # numbers and addresses: by instance, else by a confident pattern
    others = _labelled(found.where(F.col("family").isin("number", "address")))
    others = (
        others.join(known, ["label", "instance"])
        .groupBy("doc_id", "family", "start")
        .agg(F.max_by(F.struct("label", "stop", "value"), F.struct("score", "stop")).alias("b"))
        .select("doc_id", F.col("b.label").alias("pii_type"), "start", "b.stop", "b.value")
    )
    others = cut_lineage(others)  # each cut keeps the plan that the driver holds small
    unseen = (
        vouched.where(F.col("family").isin("number", "address"))
        .groupBy("doc_id", "family", "start")
        .agg(F.max_by(F.struct("label", "stop", "value"), F.struct("p_score", "stop")).alias("b"))
        .select("doc_id", F.col("b.label").alias("pii_type"), "start", "b.stop", "b.value")
    )
    others = others.unionByName(cut_lineage(_clear_of(unseen, others)))

    # names: by given name, else by a confident pattern or, for an initial, a family name that is known
    named = found.where(F.col("family") == "name").withColumn("label", F.lit("name"))
    givens = known.where(F.col("label") == "name").select("instance")
    full = named.where(~F.col("instance").endswith(".")).join(givens, "instance", "left_semi")
    middles = givens.select(F.col("instance").alias("middle"), F.lit(True).alias("middle_known"))
    is_long = F.col("long_stop").isNotNull() & (F.col("take_long") | F.coalesce("middle_known", F.lit(False)) | F.coalesce(F.col("middle").endswith("."), F.lit(False)))
    resolved = full.join(middles, "middle", "left").withColumn("is_long", is_long)
    chosen = [
        "doc_id", "grp", "start",
        F.when(F.col("is_long"), F.col("long_stop")).otherwise(F.col("stop")).alias("stop"),
        F.when(F.col("is_long"), F.col("long_value")).otherwise(F.col("value")).alias("value"),
    ]
    by_given = cut_lineage(resolved.select(*chosen, F.when(F.col("is_long"), F.col("long_tail")).otherwise(F.col("tail")).alias("tail")))
    families = by_given.select("tail").where(F.length("tail") >= 5).distinct().withColumn("tail_known", F.lit(True))
    initials = cut_lineage(named.where(F.col("instance").endswith(".")).join(middles, "middle", "left_anti"))
    in_pattern = (
        initials.select("doc_id", "start", F.explode("contexts").alias("pattern"))
        .join(confident.where(F.col("label") == "name").select("pattern"), "pattern", "left_semi")
        .select("doc_id", "start", F.lit(True).alias("in_pattern"))
        .distinct()
    )
    by_initial = (
        initials.join(families, "tail", "left")
        .join(in_pattern, ["doc_id", "start"], "left")
        .where(F.col("seed").isNotNull() | F.coalesce("tail_known", F.lit(False)) | F.coalesce("in_pattern", F.lit(False)))
        .withColumn("is_long", F.lit(False))
        .select(*chosen)
    )
    certain = cut_lineage(by_given.drop("tail").unionByName(by_initial))
    by_pattern = cut_lineage(vouched.where(F.col("family") == "name").join(middles, "middle", "left").withColumn("is_long", is_long).select(*chosen).distinct())
    # within one run of capitalized words: from the left, each name that begins after the one before has ended
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    apart = F.aggregate("all", none, lambda kept, x: F.when((F.size(kept) == 0) | (x["start"] >= F.element_at(kept, -1)["stop"]), F.array_append(kept, x)).otherwise(kept))
    names = (
        certain.unionByName(_clear_of(by_pattern, certain))
        .groupBy("doc_id", "grp")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop", "value"))).alias("all"))
        .select("doc_id", F.lit("name").alias("pii_type"), F.inline(apart))
    )
    return emails.unionByName(others).unionByName(names)


def redacted(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``doc_id, text, n_pieces``: the texts with placeholders such as ``<EMAIL>``, otherwise unchanged.

    Null and empty texts stay as they are. Of overlapping pieces the one that starts first, or the longer, counts.
    """
    spans = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("stop"), "pii_type"))).alias("spans"))

    @F.pandas_udf("text string, n_pieces int")
    def replace(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, lists):
            if text is None or found is None:
                out.append((text, 0))
                continue
            parts, at, n = [], 0, 0
            for span in found:
                if span["start"] < at:
                    continue
                parts += [text[at : span["start"]], f"<{span['pii_type'].upper()}>"]
                at, n = -span["stop"], n + 1
            out.append(("".join([*parts, text[at:]]), n))
        return pd.DataFrame(out, columns=["text", "n_pieces"])

    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return joined.select("doc_id", replace("text", "spans").alias("r")).select("doc_id", "r.text", "r.n_pieces")
