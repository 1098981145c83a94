"""String functions over columns: transcript metrics, clean-up, templating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scores as S
from .arrow import aligned_spans, char_distance, forward_spans, token_distance, wrapped  # noqa: F401

# Words that label a field, and characters that are easily taken
# for one another.
LABEL_WORDS = (
    "account", "holder", "name", "date", "description", "transaction", "history", "balance", "type", "reference",
    "details", "information", "address", "phone", "email", "amount", "total", "from", "to", "subject",
)
LABEL_ENDS = ":：#-"
AMBIGUOUS = "O0I1l"
# Fixed value: the prompt that a model may repeat before its answer.
PROMPT = r"Transcribe exactly all visible text\. Output only the text, nothing else\.?"


def normalise(s: Column) -> Column:
    """STR1: lower case, white space (Unicode) to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def words(s: Column) -> Column:
    """STR29: white-space tokens; none for a blank string."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


#: Product of two lengths up to which cell by cell is faster.
SHORT = 1_000_000


def edit_distance(a: Column, b: Column) -> Column:
    """Of two strings, by characters: the built-in for short ones, bit-parallel
    columns of the table for long ones."""
    short = F.char_length(a).cast("long") * F.char_length(b) <= SHORT
    return F.when(short, F.levenshtein(a, b)).otherwise(char_distance(F.when(~short, a), F.when(~short, b)))


def raw_cer(hyp: Column, ref: Column) -> Column:
    """STR7: edit distance over the reference's length (1 at least)."""
    return edit_distance(hyp, ref) / F.greatest(F.char_length(ref), F.lit(1))


def _rate(distance: Column, size: Column, hyp_size: Column) -> Column:
    return F.when(size > 0, distance / size).otherwise(F.when(hyp_size > 0, 1.0).otherwise(0.0))


def cer(hyp: Column, ref: Column) -> Column:
    """STR2: character error rate of normalised strings; may exceed 1. An empty
    reference gives 0 against nothing and 1 against anything."""
    h, r = normalise(hyp), normalise(ref)
    return _rate(edit_distance(h, r), F.char_length(r), F.char_length(h))


def wer(hyp: Column, ref: Column) -> Column:
    """STR3: the same rate over words."""
    h, r = words(normalise(hyp)), words(normalise(ref))
    return _rate(token_distance(h, r), F.size(r), F.size(h))


def exact_match(hyp: Column, ref: Column) -> Column:
    """STR4."""
    return normalise(hyp) == normalise(ref)


def char_accuracy(hyp: Column, ref: Column) -> Column:
    """STR5: 1 - CER, not below 0."""
    return F.greatest(F.lit(0.0), 1 - cer(hyp, ref))


def is_ambiguous(s: Column) -> Column:
    """STR8: holds a character that is easily misread."""
    return s.rlike(f"[{AMBIGUOUS}]")


def clean_prediction(s: Column) -> Column:
    """STR9: without a leading role name and without the repeated prompt."""
    bare = F.regexp_replace(F.trim(s), r"(?i)^\s*assistant\s*", "")
    return F.trim(F.regexp_replace(bare, rf"(?i)^{PROMPT}\s*", ""))


def strip_preamble(s: Column) -> Column:
    """STR10: without an announcement of the text, and without quotes around."""
    # Fixed value: how such announcements read.
    bare = F.regexp_replace(
        F.trim(s), r"(?i)^the (?:text (?:in the image )?(?:reads|is|says)|image (?:shows|contains|displays|reads))[\s:\"']*", ""
    )
    for quote in ('"', "'"):
        bare = F.regexp_replace(F.trim(bare), f"^{quote}+|{quote}+$", "")
    return F.trim(bare)


def strip_thoughts(s: Column) -> Column:
    """STR11: without <think> blocks."""
    return F.trim(F.regexp_replace(s, r"(?s)<think>.*?</think>", ""))


def html_escape(s: Column) -> Column:
    """STR12."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


def slug(s: Column) -> Column:
    """STR13: lower case without blanks and apostrophes."""
    return F.translate(F.lower(s), " '", "")


def repair_json(s: Column) -> Column:
    """STR14: a note in brackets after a string is dropped; a note naming a
    telephone system replaces the string by that system's messenger."""
    # The systems' names and their messengers.
    tail = r'\)(?=\s*[,\n\]}])'
    s = F.regexp_replace(s, r'"[^"]+"\s+\((?i:[^)]*ios[^)]*)' + tail, '"iMessage"')
    s = F.regexp_replace(s, r'"[^"]+"\s+\((?i:[^)]*android[^)]*)' + tail, '"Android Messages"')
    return F.regexp_replace(s, r'"\s*([^"]+?)\s*"\s+\([^)]+' + tail, '"$1"')


def unfence(s: Column) -> Column:
    """STR15, first half: what stands between code fences, or all."""
    bare = F.regexp_replace(F.trim(s), r"^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*```$", ""))


def is_label(word: Column) -> Column:
    """STR17: a word that ends like a label or is a known one."""
    core = F.lower(F.regexp_replace(F.trim(word), "[:：]+$", ""))
    return word.rlike(f"[{LABEL_ENDS}]$") | core.isin(*LABEL_WORDS)


def header_core(word: Column) -> Column:
    """A word without the punctuation at its end."""
    return F.trim(F.regexp_replace(F.trim(word), r"[:：.\-_#]+$", ""))


def is_upper(s: Column) -> Column:
    """Has letters, and all of them capitals."""
    return (F.upper(s) == s) & (F.lower(s) != s)


def is_header_word(word: Column) -> Column:
    """STR18, the part about the word itself."""
    core = header_core(word)
    return (F.char_length(core) >= 2) & core.rlike(r"^\p{L}+$") & is_upper(core)


def headers_of_line(words: Column) -> Column:
    """STR18: the words of one line, or null where one of them is neither in
    capitals nor without a core, so that none is a header."""
    other = lambda w: S.bound(header_core(w), lambda core: (core != "") & ~is_upper(core))
    return S.bound(words, lambda ws: F.when(~F.exists(ws, other), ws))


def key_title(key: Column) -> Column:
    """STR19: underscores to blanks, words capitalised."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def is_slug_line(s: Column) -> Column:
    """STR21: all capitals and under 60 characters."""
    return is_upper(s) & (F.char_length(s) < 60)


def paragraphs(s: Column) -> Column:
    """STR22: parts between blank lines; the whole where there is none."""
    parts = F.filter(F.transform(F.split(s, r"\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(s))


def compact_number(x: Column) -> Column:
    """STR27: four decimals, or an exponent below 0.01; "nan" for none."""
    return (
        F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "nan")
        .when(F.abs(x) >= 1e-2, F.format_string("%.4f", x))
        .otherwise(F.format_string("%.3e", x))
    )


def amount_sign(amount: Column, strip_plus: bool = False) -> Column:
    """STR28: "debit" for amounts with a minus."""
    bare = F.regexp_replace(amount, r"^\++", "") if strip_plus else amount
    return F.when(F.startswith(bare, F.lit("-")), "debit").otherwise("credit")
