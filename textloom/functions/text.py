"""Text operators as Column expressions: cleaning, sentence splitting, n-grams, shapes of strings.

Spans are half-open and count code points. Java's regular expressions count UTF-16 units and their ``\\w`` is ASCII, so
spans come from lengths and ``locate``, and word characters are written as classes. Sentence splitters give arrays of
structs (text, start, end); explode them with ``posexplode``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.batches import sliced

CJK = r"\x{4e00}-\x{9fff}"

# Named references that cleaning replaces, in this order.
REFERENCES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_html(c: Column) -> Column:
    """Tags removed, then ten character references replaced one after the other."""
    out = F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", "")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def located(parts: Column, text: Column) -> Column:
    """Structs (text, start, end) of the parts, each found at or after the end of the one before; one that is not found is
    put there. A search that goes on where the last one ended, in batches."""

    def of(found: pa.Array, whole: pa.Array) -> pa.Array:
        out = []
        for own, t in zip(found.to_pylist(), whole.to_pylist(), strict=True):
            if own is None or t is None:
                out.append(None)
                continue
            row, at = [], 0
            for part in own:
                start = t.find(part, at)
                start = at if start < 0 else start
                at = start + len(part)
                row.append({"text": part, "start": start, "end": at})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    @F.arrow_udf("array<struct<text:string,start:int,end:int>>")
    def places(found: pa.Array, whole: pa.Array) -> pa.Array:
        return sliced(of, found, whole)

    return places(parts, text)


def nonempty_parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda p: p != "")


MAIN_BREAK = r"(?<=[。！？；\n])\s*|(?<=[.!?])\s+(?=[A-Z])"


def split_sentences(c: Column) -> Column:
    """Sentences after Chinese end marks and line feeds, and after ``.!?`` before white space and a capital; with spans."""
    return located(nonempty_parts(c, MAIN_BREAK), c)


def split_clauses(c: Column) -> Column:
    """Pieces between Chinese end marks and line feeds, without spans, as word discovery takes them."""
    return nonempty_parts(c, r"[。！？；\n]")


def split_patterns(c: Column) -> Column:
    """Pieces that end with a full stop, question or exclamation mark, as sentence patterns take them."""
    return F.filter(F.split(c, r"(?<=[。！？])"), lambda p: strip(p) != "")


def split_quoted(c: Column) -> Column:
    """Pieces after end marks, six dots or two ellipses unless a closing quote follows, and after quoted ends."""
    out = F.regexp_replace(c, r"([。！？?])([^”’])", "$1\n$2")
    out = F.regexp_replace(out, r"(\.{6})([^”’])", "$1\n$2")
    out = F.regexp_replace(out, r"(…{2})([^”’])", "$1\n$2")
    out = F.regexp_replace(out, r"([。！？?][”’])([^，。！？?])", "$1\n$2")
    return nonempty_parts(out, "\n")


# An abbreviation such as Dr. and the last sign of an acronym before a word, and what ends a sentence.
ABBREVIATIONS = [r"([A-Z][a-z]{1,2}\.)", r"(\.[a-zA-Z]\.)"]
ENGINE_SENTENCE = r"(?Ud)(\S.+?[.!?])(?=\s+|$)|(\S.+?)(?=\n|$)"


def split_engine(c: Column) -> Column:
    """Sentences as the engine cuts them: the pieces of ``split_quoted``, cut after a full stop, question or exclamation mark
    before white space, but not after an abbreviation or acronym that a word follows after one white space, which becomes a
    space. A piece of one sign is a sentence."""

    def cut(piece: Column) -> Column:
        held = piece
        for a in ABBREVIATIONS:
            held = F.regexp_replace(held, rf"(?U){a}\s(\w)", "$1@$2")
        found = F.regexp_extract_all(held, F.lit(ENGINE_SENTENCE), F.lit(0))

        def undone(x: Column) -> Column:
            for a in ABBREVIATIONS:
                x = F.regexp_replace(x, rf"(?U){a}@(\w)", "$1 $2")
            return x

        return F.when(F.size(found) > 0, F.transform(found, undone)).otherwise(F.array(piece))

    return F.flatten(F.transform(split_quoted(c), cut))


def clean_cjk(c: Column) -> Column:
    """Only CJK ideographs and digits."""
    return F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\p{Nd}]", "")


def keep_class(c: Column, inside: str) -> Column:
    """Only characters of a class, e.g. ``a-z``."""
    return F.regexp_replace(c, f"[^{inside}]", "")


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def ngrams(c: Column, n: int | Column) -> Column:
    """All runs of ``n`` code points."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n) if isinstance(n, int) else n))).otherwise(F.array().cast("array<string>"))


def token_ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    last = F.size(tokens) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), separator))).otherwise(F.array().cast("array<string>"))


def bigrams(tokens: Column, end: str = "") -> Column:
    """Each token with the next one; the last with ``end``."""
    return F.transform(tokens, lambda x, i: F.concat(x, F.coalesce(F.get(tokens, i + 1), F.lit(end))))


def digits_to_zero(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}", "0")


def words(c: Column) -> Column:
    """Runs of letters, marks, digits and low lines."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def white_space_tokens(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: x != "")


def symbol_tokens(c: Column) -> Column:
    """Runs of word characters, and every other character that is not white space by itself."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"), F.lit(0))


def is_punctuation(c: Column) -> Column:
    return c.rlike(r"^\p{P}*$")


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def guess_delimiter(tokens: Column) -> Column:
    """A space where all tokens are ASCII, else nothing."""
    return F.when(F.forall(tokens, lambda t: t.rlike(r"^[\x00-\x7F]*$")), F.lit(" ")).otherwise(F.lit(""))


def mapped_tokens(tokens: Column, text: Column) -> Column:
    """Spans of tokens in their text: each is found at or after the end of the one before, else placed there."""
    return located(tokens, text)


def all_segmentations(c: Column) -> Column:
    """Every way to cut a short text into runs: 2^(n-1) arrays. One fold over the characters."""
    cs = chars(c)
    start = F.transform(F.slice(cs, 1, 1), lambda x: F.array(x))

    def step(acc: Column, x: Column) -> Column:
        joined = F.transform(acc, lambda s: F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), x))))
        apart = F.transform(acc, lambda s: F.concat(s, F.array(x)))
        return F.concat(joined, apart)

    return F.when(F.size(cs) == 0, F.array().cast("array<array<string>>")).otherwise(F.aggregate(F.slice(cs, 2, F.greatest(F.size(cs) - 1, F.lit(0))), start, step))


def cut_long(sentences: Column, most: int) -> Column:
    """Sentences up to ``most`` characters; longer ones in runs of whole clauses (after punctuation), filled greedily;
    a clause that is longer by itself is cut into pieces of ``most``."""
    none = F.array().cast("array<string>")

    def cut(s: Column) -> Column:
        clauses = F.flatten(F.transform(F.filter(F.split(s, r"(?<=\p{P})"), lambda p: p != ""), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))))
        filled = F.aggregate(
            clauses,
            none,
            lambda acc, p: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))) + F.length(p) <= most), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.get(acc, F.size(acc) - 1), p)))).otherwise(F.concat(acc, F.array(p))),
        )
        return F.when(F.length(s) <= most, F.array(s)).otherwise(filled)

    return F.flatten(F.transform(sentences, cut))


# --- sentence features -------------------------------------------------------------------------------------------


def last_char(c: Column) -> Column:
    return F.right(strip(c), F.lit(1))


def sentence_type(c: Column) -> Column:
    return F.when(last_char(c) == "？", "interrogative").when(last_char(c) == "！", "exclamatory").otherwise("declarative")


def end_mark(c: Column) -> Column:
    return F.when(last_char(c).isin("。", "？", "！"), last_char(c)).otherwise("")


def length_tier(c: Column) -> Column:
    n = F.length(strip(c))
    return F.when(n <= 10, "short").when(n <= 30, "medium").otherwise("long")


def clause_count(c: Column, marks: str = "，；") -> Column:
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit(f"[{marks}]")) + 1)


# Constructions by pattern, in order of report.
CONSTRUCTIONS = [
    ("ba_construction", rf"把[{CJK}]+[^{CJK}]*[vV]"),
    ("bei_construction", "被"),
    ("judgment_sentence", ".+者[，,].+也"),
    ("passive_classical", f"见[{CJK}]+于"),
    ("passive_classical", f"为[{CJK}]+所"),
    ("rhetorical_question", f"何[{CJK}]{{0,4}}之有"),
    ("rhetorical_question", f"不亦[{CJK}]+乎"),
    ("comparison", "孰与"),
    ("comparison", f"何[{CJK}]+如"),
    ("negation_judgment", f"非[{CJK}]+也"),
]


def constructions(c: Column) -> Column:
    """Names of the constructions that a sentence shows; one that two patterns find is named twice."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in CONSTRUCTIONS]))


def rhetorical_form(c: Column) -> Column:
    blocks = F.regexp_count(c, F.lit(f"[{CJK}]{{4}}[，。；、]")) + F.when(c.rlike(f"[{CJK}]{{4}}$"), 1).otherwise(0)
    return F.when((F.regexp_count(c, F.lit(f"[{CJK}]")) >= 8) & (blocks >= 2), "parallel").otherwise("unknown")


def limitations(c: Column, agents: Column) -> Column:
    """Hints on what cannot be told: several agents, words of passives, a rhetorical pattern."""
    return F.array_compact(
        F.array(
            F.when(agents >= 3, F.lit("hint:serial_verb")),
            F.when(F.contains(c, F.lit("者...也")) | F.contains(c, F.lit("...者，...也")), F.lit("hint:judgment_sentence")),
            F.when(c.rlike("[被见于]"), F.lit("hint:passive_voice")),
            F.when(c.rlike(f"何[{CJK}]{{1,6}}之有"), F.lit("hint:rhetorical_question")),
        )
    )


# --- dates and numbers -------------------------------------------------------------------------------------------


def normal_date(c: Column) -> Column:
    """Dates in ISO form, as exact as given; anything else unchanged."""

    def got(pattern: str, *groups: int) -> Column:
        parts = [F.regexp_extract(c, pattern, g) for g in groups]
        return F.concat_ws("-", *[p if i == 0 else F.lpad(p.cast("int").cast("string"), 2, "0") for i, p in enumerate(parts)])

    day, month, year = r"^(\d{4})年(\d{1,2})月(\d{1,2})日", r"^(\d{4})年(\d{1,2})月", r"^(\d{4})年"
    iso, other, compact = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", r"^(\d{4})(\d{2})(\d{2})"
    fine = F.regexp_extract(c, compact, 2).cast("int").between(1, 12) & F.regexp_extract(c, compact, 3).cast("int").between(1, 31)
    return (
        F.when(c.rlike(day), got(day, 1, 2, 3))
        .when(c.rlike(month), got(month, 1, 2))
        .when(c.rlike(year), F.regexp_extract(c, year, 1))
        .when(c.rlike(iso), got(iso, 1, 2, 3))
        .when(c.rlike(other), got(other, 1, 2, 3))
        .when(c.rlike(compact), F.when(fine, got(compact, 1, 2, 3)).otherwise(c))
        .otherwise(c)
    )


def is_date(c: Column) -> Column:
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    fine = F.regexp_extract(c, compact, 2).cast("int").between(1, 12) & F.regexp_extract(c, compact, 3).cast("int").between(1, 31)
    return F.when(c.rlike(compact), fine).otherwise(c.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$") | c.rlike(r"^\d{4}年(?:\d{1,2}月)?(?:\d{1,2}日)?$"))


def has_unit(c: Column) -> Column:
    """A number with something after its digits and signs."""
    t = strip(c)
    return t.rlike(r"^\p{Nd}") & (F.length(F.regexp_replace(t, r"^[\p{Nd}.,\s\-+]+", "")) > 0)


def is_standard_code(c: Column) -> Column:
    return strip(c).rlike(r"(?i)^(GB|GB/T|ISO|IEC|ASTM|DIN|JIS|EN|ANSI|IEEE|HG|SH|DL|Q/|T/|JB)")


# --- tokens ------------------------------------------------------------------------------------------------------


def translate_chars(c: Column, table: dict[str, str]) -> Column:
    """Each character by a table of characters, e.g. traditional to simplified."""
    return F.translate(c, "".join(table), "".join(table.values()))


def mapped(tokens: Column, table: dict[str, str]) -> Column:
    """Tokens by a table; others stay."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def punctuation_mask(tokens: Column) -> Column:
    return F.transform(tokens, is_punctuation)


def prepend_space(tokens: Column, text: Column) -> Column:
    """Tokens with a space in front where the text has white space before them."""
    at = located(tokens, text)
    return F.transform(at, lambda s: F.when((s["start"] > 0) & F.substring(text, s["start"], F.lit(1)).rlike(r"^\s$"), F.concat(F.lit(" "), s["text"])).otherwise(s["text"]))


def token_windows(tokens: Column, size: int, step: int) -> Column:
    """Overlapping windows of tokens; the last one ends with the tokens."""
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, size)))
