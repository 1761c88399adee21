"""From raw rows to question-answer training rows.

Each flow is one lazy chain: cheap filters and the resume anti-join come before the model call, so
a model only ever sees rows that are still needed. Model calls are Column functions
(``corpusloom.functions.models``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from corpusloom import sizing
from corpusloom.functions import text as tx
from corpusloom.functions.models import ChatModel
from corpusloom.operators import sketches
from corpusloom.operators.ranking import first_wins, top_k

# Record defaults, lengths in characters.
MIN_LENGTH = 50
PREVIEW = 500
DEFAULT_CATEGORY = "其他"

QA_REPLY = "question string, cot string, answer string, category string"
FILTER_REPLY = "should_keep boolean, reason string, suggested_question string"

SFT_COLUMNS = ["question", "cot", "answer", "language", "category", "source", "domain", "original_text_preview", "text_key"]

_ASK_QA = {
    "English": "Write one question with its answer about the text below. Reply with a JSON object "
    "holding question, cot, answer and category.\n\nText:\n",
    "Chinese": "请就下面的文本写一个问题和答案。用JSON对象回复，字段为question、cot、answer、category。\n\n文本：\n",
    "Japanese": "次の文章について質問と答えを一つ作り、question、cot、answer、categoryを持つJSONで返してください。\n\n文章：\n",
    "Korean": "다음 글에 대한 질문과 답을 하나 만들어 question, cot, answer, category가 있는 JSON으로 답하세요.\n\n글:\n",
}
_ASK_CODE = {
    "English": "Write one question with its answer about the Verilog code below; quote the code in the question. "
    "Reply with a JSON object holding question, cot, answer and category.\n\n",
    "Chinese": "请就下面的Verilog代码写一个问题和答案，问题中要包含代码。用JSON对象回复，字段为question、cot、answer、category。\n\n",
    "Japanese": "次のVerilogコードについて質問と答えを一つ作り、質問にコードを含め、question、cot、answer、categoryを持つJSONで返してください。\n\n",
    "Korean": "다음 Verilog 코드에 대한 질문과 답을 하나 만들고 질문에 코드를 넣어 question, cot, answer, category가 있는 JSON으로 답하세요.\n\n",
}
_ASK_KEEP = (
    "Decide whether the text below is worth keeping as training material. Reply with a JSON object "
    "holding should_keep, reason and suggested_question.\n\nText:\n"
)
_ASK_COT = "Explain step by step how the answer follows from the question.\n\n"


# The sentences around the first 200 characters of the question.
DEFAULT_COT_QUESTION = 200
DEFAULT_COT_HEAD = "To answer this question, I need to analyze what is being asked. The question is about: "
DEFAULT_COT_TAIL = (
    "...\n\nBased on the reference content and my knowledge, I can deduce the answer by examining the key "
    "aspects mentioned in the question.\n\nThe final answer is derived from understanding the context and "
    "applying relevant knowledge to provide a comprehensive response."
)


def by_language(language: Column, templates: dict[str, str], known: list[str] | None = None) -> Column:
    """Template of the language; English for languages without one."""
    chosen = None
    for name in known or [n for n in templates if n != "English"]:
        chosen = F.when(language == name, templates[name]) if chosen is None else chosen.when(language == name, templates[name])
    return chosen.otherwise(templates["English"]) if chosen is not None else F.lit(templates["English"])


def qa_prompt(
    language: Column, text: Column, suggested: Column | None = None, templates: dict[str, str] | None = None, limit: int | None = None
) -> Column:
    """Instruction in the row's language, then the text (its first ``limit`` characters), then any suggestion.

    With a suggestion only Chinese and English instructions are used.
    """
    table = templates or _ASK_QA
    body = tx.prefix(text, limit)
    if suggested is None:
        return F.concat(by_language(language, table), body)
    label = F.when(language == "Chinese", "\n参考问题：").otherwise("\nSuggested question: ")
    hint = F.when(F.coalesce(suggested, F.lit("")) != "", F.concat(label, suggested)).otherwise("")
    return F.concat(by_language(language, table, ["Chinese"]), body, F.lit("\n"), hint)


def code_prompt(language: Column, code: Column, description: Column, templates: dict[str, str] | None = None) -> Column:
    part = lambda name: F.coalesce(description[name], F.lit(""))
    return F.concat(
        by_language(language, templates or _ASK_CODE),
        F.lit("```verilog\n"), code, F.lit("\n```\n\n- "),
        part("high_level_global_summary"), F.lit("\n- "),
        part("detailed_global_summary"), F.lit("\n- "),
        part("block_summary"),
    )


def cot_prompt(question: Column, answer: Column, reference: Column, limit: int | None = None) -> Column:
    cited = F.when(
        F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("\n\nReference:\n"), tx.prefix(reference, limit))
    ).otherwise("")
    return F.concat(F.lit(_ASK_COT + "Question:\n"), question, F.lit("\n\nAnswer:\n"), answer, cited)


def default_cot(question: Column) -> Column:
    """Reasoning text used when the model gave none."""
    return F.concat(F.lit(DEFAULT_COT_HEAD), tx.prefix(question, DEFAULT_COT_QUESTION), F.lit(DEFAULT_COT_TAIL))


def head_rows(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows of the input, or all of it."""
    return df if n is None else df.orderBy(*order).limit(n)


def without_done(
    df: DataFrame, done: DataFrame | None, key: Column, done_key: Column, row_key: list[str], max_rows: int = sizing.MAX_BROADCAST_ROWS
) -> DataFrame:
    """Rows whose key no earlier output row has. Duplicates inside the input stay.

    Beyond ``max_rows`` keys a sketch of them clears most new rows, so that only the others' texts are shuffled.
    """
    if done is None:
        return df
    seen = done.select(done_key.alias("_key")).filter("_key is not null").distinct()
    keyed = df.withColumn("_key", key)
    if sizing.is_small(seen, max_rows):
        return keyed.join(F.broadcast(seen), "_key", "left_anti").drop("_key")
    return sketches.anti_join(keyed, seen, "_key", row_key).drop("_key")


def done_key(done: DataFrame | None) -> Column:
    """Key of earlier output: that of the whole text the row was made from.

    Output without ``text_key`` is known by its preview where that is the whole text; a longer text is not
    taken for done because another one begins like it.
    """
    columns = done.columns if done is not None else []
    preview = tx.blank_to_null(F.col("original_text_preview"))
    known = [F.col("text_key")] if "text_key" in columns else []
    if "original_text_preview" in columns:
        known.append(F.when(F.length(preview) < PREVIEW, tx.prefix_key(preview)))
    return F.coalesce(*known) if known else F.lit(None).cast("string")


def _filled(*names: str) -> Column:
    check = F.lit(True)
    for name in names:
        check = check & (F.coalesce(F.col(name), F.lit("")) != "")
    return check


def ask(df: DataFrame, chat: ChatModel, prompt: Column, ddl: str, name: str = "reply") -> DataFrame:
    """Add the parsed reply to ``prompt``. The raw reply gets a projection of its own: one call per row."""
    replied = df.withColumn("_raw", chat.reply(prompt))
    return replied.withColumn(name, tx.parse_reply(F.col("_raw"), ddl)).drop("_raw")


def _identified(df: DataFrame, text: str) -> DataFrame:
    """Add the preview of the source text and the key of the whole of it."""
    return df.withColumns({"original_text_preview": tx.prefix(F.col(text), PREVIEW), "text_key": tx.prefix_key(F.col(text))})


def _records(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Training records from a parsed ``reply`` struct; rows lacking question or answer are dropped."""
    return df.select(
        *[c for c in df.columns if c.startswith("id")],
        F.coalesce("reply.question", F.lit("")).alias("question"),
        F.coalesce("reply.cot", F.lit("")).alias("cot"),
        F.coalesce("reply.answer", F.lit("")).alias("answer"),
        "language",
        F.coalesce("reply.category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        "source",
        "domain",
        "original_text_preview",
        "text_key",
        *(extra or []),
    ).filter(_filled("question", "answer"))


def textbook_rows(
    df: DataFrame, chat: ChatModel, done: DataFrame | None = None, language: Column | None = None, min_length: int = MIN_LENGTH
) -> DataFrame:
    """Rows of (id, text, source, domain) to question-answer records."""
    kept = df.filter(tx.long_enough(F.col("text"), min_length))
    kept = without_done(kept, done, tx.prefix_key(F.col("text")), done_key(done), ["id"])
    asked = kept.withColumn("language", language if language is not None else tx.script_language(F.col("text")))
    replied = ask(asked, chat, qa_prompt(F.col("language"), F.col("text")), QA_REPLY)
    return _records(_identified(replied, "text"))


def keep_verdict(df: DataFrame, judge: ChatModel, limit: int | None = None) -> DataFrame:
    """Add ``keep``, ``reason`` and ``suggested_question``; an unreadable reply means drop. The judge sees ``limit`` characters or all.

    ``should_keep`` has to be a JSON boolean: the string "false" does not keep a row.
    """
    prompt = F.concat(F.lit(_ASK_KEEP), tx.prefix(F.col("text"), limit))
    parsed = ask(df, judge, prompt, FILTER_REPLY, "_verdict")
    return (
        parsed.withColumn("keep", F.coalesce("_verdict.should_keep", F.lit(False)))
        .withColumn("reason", F.coalesce("_verdict.reason", F.lit("")))
        .withColumn("suggested_question", F.col("_verdict.suggested_question"))
        .drop("_verdict")
    )


def judged_rows(
    df: DataFrame, judge: ChatModel, chat: ChatModel, done: DataFrame | None = None, min_length: int = MIN_LENGTH, counters: Counters | None = None
) -> DataFrame:
    """Rows of (id, text, source, section): keep/drop verdict first, then question generation.

    ``counters`` see the rows that are judged (``total``), kept by the judge (``kept``) and returned (``success``).
    """
    at = counters.at if counters else lambda rows, _: rows
    kept = df.filter(tx.long_enough(F.col("text"), min_length))
    kept = at(without_done(kept, done, tx.prefix_key(F.col("text")), done_key(done), ["id"]), "total")
    judged = at(keep_verdict(kept, judge).filter("keep"), "kept")
    asked = judged.withColumn("language", tx.script_language(F.col("text")))
    prompt = qa_prompt(F.col("language"), F.col("text"), F.col("suggested_question"))
    replied = ask(asked, chat, prompt, QA_REPLY)
    records = _records(
        _identified(replied, "text")
        .withColumn("domain", F.col("section"))
        .withColumn("filter_reason", F.col("reason")),
        ["filter_reason"],
    )
    return at(records, "success")


def code_rows(
    df: DataFrame, chat: ChatModel, source: str, domain: str, done: DataFrame | None = None, min_length: int = MIN_LENGTH
) -> DataFrame:
    """Rows of (id, code, description): the language is read off the first filled description."""
    kept = df.filter(tx.long_enough(F.col("code"), min_length))
    kept = without_done(kept, done, tx.prefix_key(F.col("code")), done_key(done), ["id"])
    described = tx.first_filled(
        F.col("description.detailed_global_summary"),
        F.col("description.high_level_global_summary"),
        F.col("description.block_summary"),
    )
    asked = kept.withColumn("language", tx.script_language(described))
    prompt = code_prompt(F.col("language"), F.col("code"), F.col("description"))
    return _records(
        _identified(ask(asked, chat, prompt, QA_REPLY), "code")
        .withColumn("source", F.lit(source))
        .withColumn("domain", F.lit(domain))
    )


def answered_rows(
    df: DataFrame, chat: ChatModel, source: str, domain: str, language: str = "English", done: DataFrame | None = None
) -> DataFrame:
    """Rows of (conversation_id, category, conversation): keep question and answer, add reasoning.

    Resuming compares one key on both sides, md5(conversation_id:question), so ``done`` needs a
    ``conversation_id`` column next to ``question``.
    """
    first = F.get("conversation", F.lit(0))
    turns = df.select(
        "conversation_id",
        F.coalesce("category", F.lit("Others")).alias("category"),
        tx.strip(first["question"]).alias("question"),
        tx.strip(first["answer"]).alias("answer"),
        F.coalesce(first["reference_content"], F.lit("")).alias("reference"),
    ).filter(_filled("question", "answer"))
    key = tx.item_key(F.col("conversation_id"), F.col("question"))
    turns = without_done(turns, done, key, key, ["conversation_id"])
    replied = turns.withColumn("_cot", chat.reply(cot_prompt(F.col("question"), F.col("answer"), F.col("reference"))))
    return replied.select(
        "conversation_id",
        "question",
        F.coalesce(tx.strip(F.col("_cot")), default_cot(F.col("question"))).alias("cot"),
        "answer",
        F.lit(language).alias("language"),
        "category",
        F.lit(source).alias("source"),
        F.lit(domain).alias("domain"),
        tx.prefix(F.col("reference"), PREVIEW).alias("original_text_preview"),
    )


class Counters:
    """Numbers of rows that pass named places of a flow, counted while its result is written: no second pass.

    Serves one action; a stage that is computed again after an executor was lost may count its rows again.
    """

    def __init__(self, name: str = "flow"):
        self.name = name
        self._seen: dict[str, Observation] = {}

    def at(self, df: DataFrame, place: str) -> DataFrame:
        self._seen[place] = Observation(f"{self.name}-{place}")
        return df.observe(self._seen[place], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """Per place its rows, once the action has ended; 0 where the plan left a place out because nothing reaches it."""
        return {place: int(seen.get.get("n", 0)) for place, seen in self._seen.items()}

    def run(self) -> dict[str, int]:
        """Total, success, filtered and failed from the places ``total``, ``kept`` and ``success``."""
        n = self.counts()
        return {"total": n["total"], "success": n["success"], "filtered": n["total"] - n["kept"], "failed": n["kept"] - n["success"]}


def run_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Run summary: total, success, filtered, failed."""
    is_ = lambda name: F.count_if(F.col(status) == name)
    return df.agg(
        F.count("*").alias("total"),
        is_("success").alias("success"),
        is_("filtered").alias("filtered"),
        (F.count("*") - is_("success") - is_("filtered")).alias("failed"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of every column in one pass: (dimension, value, n)."""
    sets = [[c] for c in columns]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    counted = grouped.agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("_gid"))
    top = 1 << len(columns)
    dimension = value = None
    for i, name in enumerate(columns):
        here = F.col("_gid") == (top - 1 - (1 << (len(columns) - 1 - i)))
        text = F.col(name).cast("string")
        dimension = F.when(here, name) if dimension is None else dimension.when(here, name)
        value = F.when(here, text) if value is None else value.when(here, text)
    return counted.select(dimension.alias("dimension"), value.alias("value"), "n")


def shuffle_key(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]).cast("binary"))


def split_rows(df: DataFrame, group: str, row_id: str, n_test: int = 30, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(test, train): the ``n_test`` first rows of each group in a seeded order, and the rest.

    ``group`` has few values by contract (languages). The test side is a map-side-cut top-k;
    its ids (groups x n_test) are broadcast for the anti-join, so no group is sorted whole.
    """
    keyed = df.withColumn("_at", shuffle_key(seed, row_id))
    test = top_k(keyed, [group], [F.asc("_at"), F.asc(row_id)], n_test, "_rank").drop("_rank", "_at")
    ids = test.select(row_id)
    ids = F.broadcast(ids) if sizing.is_small(ids) else ids
    return test, df.join(ids, row_id, "left_anti")


def seeded_order(df: DataFrame, row_id: str, seed: int = 43) -> DataFrame:
    """Rows in the seeded order of the written file (a range-partitioned global sort)."""
    return df.orderBy(shuffle_key(seed, row_id), F.col(row_id))


def leaked(test: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """Training rows whose content key also occurs in the test rows."""
    keys = test.select(key.alias("_key")).distinct()
    return sizing.lookup_join(train.withColumn("_key", key), keys, ["_key"], "left_semi", train.columns[:1]).drop("_key")


def drop_repeats(df: DataFrame, key: Column, order: str) -> DataFrame:
    """First row per content key."""
    return first_wins(df.withColumn("_key", key), ["_key"], [F.asc(order)]).drop("_key")


