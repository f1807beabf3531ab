"""Text functions as Catalyst expressions: normalisation, tokens, sentences, headings, token estimates, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

TOKEN = r"[a-z][a-z0-9]*(?:[-'][a-z0-9]+)*"
UNIT = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SEGMENT = r"[^.!?]+[.!?]*|.+$"
LABELLED = r"(?is)(?:^|\s)(?:[0-9]+[.)]?\s*)?\[([a-z][a-z0-9-]*)\]\s*(.*?)(?=\s+(?:[0-9]+[.)]?\s*)?\[[a-z][a-z0-9-]*\]|$)"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
_ABBREVIATION = "|".join(a.replace(".", r"\.") for a in P.ABBREVIATIONS)
_BOUNDARY = rf"(?<=[.!?])(?<!(?i:{_ABBREVIATION}))[\"')\]}}]*(?: +(?=[A-Z0-9\[(])| *\z)"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once for a row, however often f uses it: it is bound as the one element of an array."""
    return F.get(F.transform(F.array(value), f), 0)


def normalize_text(text: Column) -> Column:
    """Soft hyphens out, ligatures spelt out, hyphenated line ends joined, quotes straightened, white space collapsed. Null gives an empty string."""
    out = F.coalesce(text, F.lit(""))
    for sign, letters in {"­": "", **LIGATURES, "‘": "'", "’": "'", "“": '"', "”": '"'}.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.regexp_replace(out, rf"([A-Za-z])-{P.SPACE}+([a-z])", "$1$2")
    # Single blanks, which most white space is, are no match.
    return F.trim(F.regexp_replace(out, f"{P.OTHER_SPACE}{P.SPACE}*| {P.SPACE}+", " "))


def normalize_again(text: Column) -> Column:
    """normalize_text() of what was cut from a normalised text at its blanks: only a second hyphen of a chain such as "a- b- c" can still change."""
    return F.when(text.contains("- "), normalize_text(text)).otherwise(F.coalesce(text, F.lit("")))


def tokens(normal: Column) -> Column:
    """Words of a normalised text without stop words and single letters, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(normal), F.lit(TOKEN), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*P.STOP_WORDS))


def terms(words: Column) -> Column:
    """The tokens, then each with its successor."""
    n = F.size(words) - 1
    pairs = F.when(n > 0, F.zip_with(F.slice(words, 1, F.greatest(n, F.lit(0))), F.slice(words, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, F.lit("__"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def sentences(normal: Column) -> Column:
    """Sentences of a normalised text. One ends at . ! or ? that no abbreviation ends with, if a capital, digit or bracket follows; closing quotes after it are lost."""
    return F.filter(F.split(normal, _BOUNDARY, -1), lambda s: s != "")


def words(text: Column) -> Column:
    """Pieces of a text between blanks; an empty text has one, empty, piece."""
    return F.split(text, r"\s+", -1)


def n_words(normal: Column) -> Column:
    """Number of pieces between blanks of a normalised text; none in an empty one."""
    return F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1)


def join_tokens(items: Column) -> Column:
    """Join by blanks, with none before closing or after opening punctuation."""
    step = lambda out, t: F.when(t == "", out).when((out == "") | t.rlike(r"^[,.;:!?%)\]}]") | out.rlike(r"[(\[{/$]\z"), F.concat(out, t)).otherwise(F.concat(out, F.lit(" "), t))
    return F.aggregate(items, F.lit(""), step)


def heading(text: Column) -> Column:
    """A section's name if the text is a heading, else null: a known name, or a number and a title in capitals."""
    known, none = rf"(?i)^({'|'.join(P.SECTIONS)})$", F.lit(None).cast("string")
    number = r"^[0-9]+(?:\.[0-9]+)*[.)]?\s+(.+)$"
    connectors = F.array(*(F.lit(w) for w in P.CONNECTORS))

    def named(title: Column) -> Column:
        content = F.filter(F.regexp_extract_all(title, F.lit("[A-Za-z][A-Za-z-]*"), F.lit(0)), lambda w: ~F.array_contains(connectors, F.lower(w)))
        capitals = let(content, lambda c: (F.size(c) > 0) & (F.size(F.filter(c, lambda w: w.rlike("^[A-Z]"))) / F.size(c) >= 0.65))
        return F.when((title == "") | (F.size(words(title)) > 12) | title.rlike(r"[:!?]\z"), none).when(title.rlike(known) | capitals, F.lower(title))

    def of(s: Column) -> Column:
        title = F.regexp_replace(normalize_text(F.regexp_extract(s, number, 1)), r"[.]\z", "")
        return F.when((s == "") | (F.length(s) > 90), none).when(s.rlike(known), F.lower(s)).when(s.rlike(number), let(title, named))

    return let(normalize_text(text), of)


def is_reference_heading(name: Column) -> Column:
    return F.lower(normalize_text(name)).isin(*P.REFERENCE_HEADINGS)


def is_post_reference_heading(name: Column) -> Column:
    return F.lower(normalize_text(name)).isin(*P.POST_REFERENCE_HEADINGS)


def clean_summary_sentence(text: Column) -> Column:
    """Without a leading number and label."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*[0-9]+\.\s*", "")
    return normalize_text(F.regexp_replace(out, r"^\s*\[[A-Za-z][A-Za-z0-9-]*\]\s*", ""))


def labelled_entries(summary: Column, labels: list[str] | None = None) -> Column:
    """[(label, sentence)] of a labelled summary; labels: the only names taken, if any."""
    s = F.coalesce(summary, F.lit(""))
    names, bodies = (F.regexp_extract_all(s, F.lit(LABELLED), F.lit(i)) for i in (1, 2))
    entries = F.zip_with(names, bodies, lambda n, b: F.struct(F.concat(F.lit("["), n, F.lit("]")).alias("label"), clean_summary_sentence(b).alias("sentence")))
    kept = F.filter(entries, lambda e: e["sentence"] != "")
    return F.filter(kept, lambda e: e["label"].isin(*labels)) if labels else kept


def estimate_tokens(text: Column) -> Column:
    """A third of each run of letters and digits, rounded up, and one for any other sign."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    return F.aggregate(units, F.lit(0).cast("long"), lambda n, u: n + F.when(u.rlike(r"^[\p{L}\p{N}]"), F.ceil(F.length(u) / 3)).otherwise(F.lit(1)).cast("long"))


def segments(text: Column) -> Column:
    """A text's segments up to and with their terminators."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEGMENT), F.lit(0))


def chunks_by_sentences(text: Column, n: int) -> Column:
    """Groups of n segments, joined by blanks; blank ones are left out."""
    s = segments(text)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / n) - 1, F.lit(0)).cast("int")), lambda g: F.trim(F.array_join(F.slice(s, g * n + 1, F.lit(n)), " ")))
    return F.filter(groups, lambda c: c != "")


def margin_signature(text: Column) -> Column:
    """Lower-cased, with each run of digits as #."""
    return F.regexp_replace(F.lower(normalize_text(text)), "[0-9]+", "#")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sort_index(page: Column, height: Column, top: Column, left: Column) -> Column:
    """Page, distance from the top and left edge in hundredths, of 5, 6 and 5 digits."""
    part = lambda x, most, n: F.lpad(F.least(F.greatest(x, F.lit(0)), F.lit(most)).cast("long").cast("string"), n, "0")
    return F.concat_ws("|", part(page.cast("long"), 99_999, 5), part(round_half_up((height - top) * 100), 999_999, 6), part(round_half_up(left * 100), 99_999, 5))


def summary_prompt(text: Column, n: int, labels: list[dict] | None = None) -> Column:
    """The text, the labels' block, and the instruction last."""
    block = "" if not labels else "Labels:\n" + "\n".join(f"{x['name']}: {x['description']}" for x in labels) + "\n\nStart each sentence with the label that fits it best."
    ask = f"Summarise the text above in {n} sentences. Use whole sentences, one to a line, and nothing else."
    return F.concat_ws("\n\n", text, *([F.lit(block)] if block else []), F.lit(ask))


def format_bytes(n: Column) -> Column:
    """Bytes as text with a unit."""
    return F.when(n >= 1 << 30, F.format_string("%.1f GB", n / float(1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 1024, F.format_string("%.0f KB", n / 1024.0)).otherwise(F.format_string("%d B", n.cast("long")))
