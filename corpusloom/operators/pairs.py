"""Hard negatives and the training-row shapes made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import arrays
from corpusloom.operators import cell_join, cells, dense
from corpusloom.operators.ranking import SCORE_DIGITS, by_score, top_k

# The pointwise reranker's record texts.
JUDGE_SYSTEM = (
    "Judge whether the Document meets the requirements based on the Query and the Instruct provided. "
    'Note that the answer can only be "yes" or "no".'
)
JUDGE_INSTRUCT = "Given a search query, retrieve relevant passages that answer the query'"
JUDGE_ANSWER = "<think>\n\n</think>\n\n"


def hard_negatives(
    pairs: DataFrame,
    pair_id: str = "pair_id",
    anchor: str = "anchor_vector",
    positive: str = "positive_vector",
    num_negatives: int = 5,
    range_min: int = 20,
    range_max: int = 50,
    max_score: float | None = 0.8,
    absolute_margin: float | None = 0.1,
    path: str | None = None,
    report: dict[str, int] | None = None,
) -> DataFrame:
    """(pair_id, negative_id, score, positive_score, rank) per question-answer pair.

    Candidates are the other pairs' positives, ranked by similarity to the anchor. The nearest
    ``range_min`` are skipped and ranks up to ``range_max`` considered; of those scoring at most
    ``max_score`` and at least ``absolute_margin`` below the own positive, the best
    ``num_negatives`` stay. One rank more than needed is searched because the own positive is
    among the candidates. With ``path``, a new folder that all executors share, the candidates are stored
    there in cells and only pairs that can be among an anchor's nearest are scored, with equal results;
    ``report`` then receives how many there are and were scored.
    """
    candidates = pairs.select(F.col(pair_id).alias("negative_id"), F.col(positive).alias("_v"))
    if path is None:
        near = dense.search(candidates, pairs, range_max + 1, "negative_id", "_v", pair_id, anchor)
    else:
        near = cell_join.nearest(cells.build(candidates, "negative_id", "_v", path), pairs, range_max + 1, pair_id, anchor, report)
    others = top_k(
        near.filter(F.col(pair_id) != F.col("negative_id")).drop("rank"), [pair_id], by_score("score", "negative_id"), range_max
    ).filter(F.col("rank") > range_min)
    own = pairs.select(pair_id, F.round(arrays.dot(F.col(anchor), F.col(positive)), SCORE_DIGITS).alias("positive_score"))
    scored = others.drop("rank").join(own, pair_id)
    if max_score is not None:
        scored = scored.filter(F.col("score") <= max_score)
    if absolute_margin is not None:
        scored = scored.filter(F.round(F.col("score") + absolute_margin, SCORE_DIGITS) <= F.col("positive_score"))
    return top_k(scored, [pair_id], by_score("score", "negative_id"), num_negatives)


def labeled_list(pairs: DataFrame, negatives: DataFrame, pair_id: str, question: str, answer: str) -> DataFrame:
    """(pair_id, question, answer[], labels[]): the positive first, then its negatives by rank.

    Pairs without any negative are dropped. Arrays hold at most one positive and the mined few.
    """
    texts = pairs.select(F.col(pair_id).alias("negative_id"), F.col(answer).alias("text"))
    named = negatives.select(pair_id, "negative_id", "rank").join(texts, "negative_id")
    grouped = named.groupBy(pair_id).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_neg"))
    return pairs.select(pair_id, question, answer).join(grouped, pair_id).select(
        pair_id,
        F.col(question).alias("question"),
        F.concat(F.array(answer), F.col("_neg.text")).alias("answer"),
        F.concat(F.array(F.lit(1)), F.transform("_neg", lambda _: F.lit(0))).alias("labels"),
    )


def with_label(answers: Column, labels: Column, label: int) -> Column:
    """Members of ``answers`` whose parallel label matches."""
    return F.filter(answers, lambda _, i: F.get(labels, i) == label)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def contrastive_rows(labeled: DataFrame) -> DataFrame:
    """messages / positive_messages / negative_messages from labelled lists."""
    turns = lambda label: F.transform(
        with_label(F.col("answer"), F.col("labels"), label), lambda t: F.array(message("user", t))
    )
    return labeled.withColumns(
        {
            "messages": F.array(message("user", F.col("question"))),
            "positive_messages": turns(1),
            "negative_messages": turns(0),
        }
    ).drop("question", "answer", "labels")


def rerank_rows(labeled: DataFrame) -> DataFrame:
    """query / response / rejected_response from labelled lists."""
    return labeled.withColumns(
        {
            "query": F.col("question"),
            "response": F.get(with_label(F.col("answer"), F.col("labels"), 1), F.lit(0)),
            "rejected_response": with_label(F.col("answer"), F.col("labels"), 0),
        }
    ).drop("question", "answer", "labels")


def pointwise_rows(reranked: DataFrame) -> DataFrame:
    """One three-message record per rejected response ("no"), then one for the response ("yes")."""
    judged = F.concat(
        F.transform(F.coalesce("rejected_response", F.array()), lambda t: F.struct(t.alias("text"), F.lit("no").alias("verdict"))),
        F.array(F.struct(F.col("response").alias("text"), F.lit("yes").alias("verdict"))),
    )
    rows = reranked.select("*", F.posexplode(judged).alias("at", "_j")).drop("response", "rejected_response")
    asked = F.concat(
        F.lit(f"<Instruct>: {JUDGE_INSTRUCT}\n<Query>: "), F.col("query"), F.lit("\n<Document>: "), F.col("_j.text")
    )
    return rows.withColumn(
        "messages",
        F.array(
            message("system", F.lit(JUDGE_SYSTEM)),
            message("user", asked),
            message("assistant", F.concat(F.lit(JUDGE_ANSWER), F.col("_j.verdict"))),
        ),
    ).drop("query", "_j")
