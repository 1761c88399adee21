"""Text expressions. Every function maps Columns to a Column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions.arrays import let

# The code points Python's str.strip() removes.
WHITESPACE = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Token and script patterns.
TOKEN_PATTERN = r"([a-z]+|[\x{4e00}-\x{9fff}])"
CHINESE = r"[\x{4e00}-\x{9fff}]"
JAPANESE = r"[\x{3040}-\x{30ff}]"
KOREAN = r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]"
ENGLISH = r"[A-Za-z]"
ROUGE_TOKEN = r"([a-z0-9]+)"

# Answers a model may give when asked for a language, in order of precedence.
LANGUAGE_NAMES = [
    "Chinese", "English", "Japanese", "Korean", "French",
    "German", "Spanish", "Russian", "Italian", "Portuguese",
]

# The mteval-13a rules (pattern, replacement) applied in this order.
MTEVAL_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
MTEVAL_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# Single capitals of the letters whose upper case is otherwise written with several characters, such as ß and ᾳ.
_CAPITALS = {
    small: capital
    for capital, small in ((chr(i), chr(i).lower()) for i in range(0x1E00, 0x2000))
    if len(small) == 1 and small != capital and len(small.upper()) > 1
}


def initial(text: Column) -> Column:
    """First character of a text as a capital, always one character: a letter without a single capital stays as it is."""
    first = F.translate(F.substring(text, 1, 1), "".join(_CAPITALS), "".join(_CAPITALS.values()))
    return let(first, lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c))


def first_filled(*texts: Column) -> Column:
    """The first value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(t) for t in texts], F.lit(""))


def prefix(text: Column, n: int | None) -> Column:
    """First ``n`` code points, the whole text without ``n``."""
    return text if n is None else F.substring(text, 1, n)


def prefix_key(text: Column, n: int | None = None) -> Column:
    """md5 of the text, the identity used to resume a run; with ``n`` of its first ``n`` code points only."""
    return F.md5(prefix(text, n).cast("binary"))


def item_key(item_id: Column, question: Column, n: int | None = None) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(item_id.cast("string"), F.lit("")), prefix(question, n)).cast("binary"))


def long_enough(text: Column, n: int = 50) -> Column:
    return F.coalesce(F.length(strip(text)) >= n, F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-cased Latin letter runs and single CJK ideographs, in order; all else is dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ROUGE_TOKEN), F.lit(1))


def mteval_tokens(text: Column) -> Column:
    """mteval-v13a word tokens."""
    line = F.replace(text, F.lit("<skipped>"), F.lit(""))
    line = F.replace(line, F.lit("-\n"), F.lit(""))
    line = F.replace(line, F.lit("\n"), F.lit(" "))
    for entity, char in MTEVAL_ENTITIES:
        line = F.replace(line, F.lit(entity), F.lit(char))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in MTEVAL_13A:
        line = F.regexp_replace(line, pattern, replacement)
    return F.filter(F.split(line, r"(?U)[\s\x1c-\x1f]+"), lambda word: word != "")


def script_language(text: Column) -> Column:
    """Language with most characters; ties go Chinese, Japanese, Korean, English; none is English."""
    size = F.length(text)
    found = F.array(*[size - F.length(F.regexp_replace(text, p + "+", "")) for p in (CHINESE, JAPANESE, KOREAN, ENGLISH)])
    names = ("Chinese", "Japanese", "Korean", "English")

    def largest(counts: Column) -> Column:
        place = F.when(F.array_max(counts) > 0, F.array_position(counts, F.array_max(counts)))
        return F.get(F.array(*[F.lit(n) for n in names]), (F.coalesce(place, F.lit(4)) - 1).cast("int"))

    # One scan settles texts without any CJK, kana or hangul.
    return F.when(~text.rlike(f"{CHINESE}|{JAPANESE}|{KOREAN}"), "English").otherwise(let(found, largest))


def any_script_language(text: Column) -> Column:
    """First of Chinese, Japanese, Korean of which any character occurs, else English."""
    return (
        F.when(text.rlike(CHINESE), "Chinese")
        .when(text.rlike(JAPANESE), "Japanese")
        .when(text.rlike(KOREAN), "Korean")
        .otherwise("English")
    )


def named_language(reply: Column, text: Column) -> Column:
    """Language named in a model's reply, falling back on the script count."""
    said = F.lower(F.coalesce(reply, F.lit("")))
    named = None
    for name in LANGUAGE_NAMES:
        hit = F.contains(said, F.lit(name.lower()))
        named = F.when(hit, name) if named is None else named.when(hit, name)
    return named.otherwise(script_language(text))


def unfence(reply: Column) -> Column:
    """Reply without a surrounding Markdown code fence."""
    out = F.regexp_replace(reply, r"^```json\s*", "")
    out = F.regexp_replace(out, r"^```\s*", "")
    out = F.regexp_replace(out, r"\s*```\z", "")
    return strip(out)


def parse_reply(reply: Column, ddl: str) -> Column:
    """Struct parsed from a fenced JSON reply; its fields are NULL when the reply is not a JSON object."""
    body = unfence(reply)
    return F.from_json(F.when(body.startswith("{"), body), ddl)


def after_think(output: Column) -> tuple[Column, Column]:
    """(thinking, answer) split on the last ``</think>`` marker; no marker means no thinking."""
    marker = "</think>"
    has = F.contains(output, F.lit(marker))
    answer = F.when(has, F.substring_index(output, marker, -1)).otherwise(output)
    thinking = F.when(has, F.left(output, F.length(output) - F.length(answer) - len(marker))).otherwise(F.lit(""))
    thinking = F.replace(thinking, F.lit("<think>"), F.lit(""))
    newline = F.lit("\n")
    return F.trim(thinking, newline), F.trim(answer, newline)


def error_code(message: Column) -> Column:
    """Upstream status named in an error message; 500 when there is none."""
    code = F.regexp_extract(message, r"Error code:\s*(\d{3})", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("500")).cast("int")


def rerank_endpoint(host: Column) -> Column:
    bare = F.rtrim(strip(host), F.lit("/"))
    path = "/v1/rerank"
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "")
        .when(bare.endswith(path), bare)
        .otherwise(F.concat(bare, F.lit(path)))
    )


def document_type(filename: Column) -> Column:
    """PDF, Word or Excel by extension; NULL for files the loader does not take."""
    name = F.lower(filename)
    return (
        F.when(name.rlike(r"\.pdf\z"), "PDF")
        .when(name.rlike(r"\.docx?\z"), "Word")
        .when(name.rlike(r"\.xlsx?\z"), "Excel")
    )


def chunk_id(filename: Column, page: Column, level: Column, index: Column) -> Column:
    return F.format_string("%s::p%d::l%d::%d", filename, page, level, index)


def server_event(payload: Column) -> Column:
    """One server-sent event carrying a struct as JSON."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
