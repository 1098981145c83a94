"""Text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query

def pairs(t):
    """Each turn as the reference of the next one: a stand-in for transcripts."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    # The window's own shuffle, but with a number of partitions that stays: turns are few bytes and much work.
    turns = t.conversations.select("conv_id", "turn", "text").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    return turns.select("conv_id", "turn", F.col("text").alias("r"), nxt.alias("h")).filter("h IS NOT NULL")


# The edit distance of SQL counts bytes: letters that need two are first put to
# characters of one. These are all there are in the conversations.
TWO_BYTES = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 27)])
NORM_SQL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


def bytes_sql(column: str) -> str:
    return f"translate({column}, '{TWO_BYTES}', {ONE_BYTE})"


PAIRS_SQL = "SELECT conv_id, turn, text AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations"


def cer_sql(h: str, r: str) -> str:
    h, r = NORM_SQL.format(h), NORM_SQL.format(r)
    distance = f"levenshtein({bytes_sql(h)}, {bytes_sql(r)})"
    return f"CASE WHEN length({r}) > 0 THEN {distance} / length({r}) WHEN length({h}) > 0 THEN 1 ELSE 0 END"


RAW_SQL = f"round(levenshtein({bytes_sql('h')}, {bytes_sql('r')}) / greatest(length(r), 1), 6)"


@query(f"SELECT conv_id, turn, round({cer_sql('h', 'r')}, 6) AS rate, {RAW_SQL} AS raw FROM ({PAIRS_SQL}) WHERE h IS NOT NULL")
def cer_pairs(t):
    return pairs(t).select("conv_id", "turn", F.round(T.cer(F.col("h"), F.col("r")), 6).alias("rate"), F.round(T.raw_cer(F.col("h"), F.col("r")), 6).alias("raw"))


@query(f"SELECT conv_id, turn, {RAW_SQL} AS raw FROM ({PAIRS_SQL}) WHERE h IS NOT NULL")
def cer_raw(t):
    """STR7."""
    return pairs(t).select("conv_id", "turn", F.round(T.raw_cer(F.col("h"), F.col("r")), 6).alias("raw"))


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({NORM_SQL.format(x)}, '\\s+'), lambda x: x <> '')"


#: Edit distance of lists h and r: each word of h makes the next row of the table.
TOKENS_SQL = """list_reduce(list_prepend(range(0, len(r) + 1), list_transform(h, lambda x: [CAST(hash(x) >> 1 AS BIGINT)])), lambda prev, x:
list_reduce(list_prepend([prev[1] + 1], list_transform(range(1, len(r) + 1), lambda j: [j])), lambda acc, j:
list_append(acc, least(prev[j[1] + 1] + 1, acc[-1] + 1, prev[j[1]] + CASE WHEN CAST(hash(r[j[1]]) >> 1 AS BIGINT) = x[1] THEN 0 ELSE 1 END))))[-1]"""
WER_SQL = f"CASE WHEN len(r) > 0 THEN {TOKENS_SQL} / len(r) WHEN len(h) > 0 THEN 1 ELSE 0 END"


@query(f"SELECT conv_id, turn, round({WER_SQL}, 6) AS rate FROM (SELECT conv_id, turn, {words_sql('h')} AS h, {words_sql('r')} AS r FROM ({PAIRS_SQL}) WHERE h IS NOT NULL)")
def wer_pairs(t):
    return pairs(t).select("conv_id", "turn", F.round(T.wer(F.col("h"), F.col("r")), 6).alias("rate"))


@query("""WITH r AS (SELECT doc_id, m.model, m.kind, m.reading FROM documents, LATERAL (VALUES ('m1', 'clean', text), ('m1', 'adv', translate(text, 'ae', 'ea')), ('m2', 'clean', lower(text)), ('m2', 'adv', text)) m(model, kind, reading))
SELECT c.doc_id, c.model, length(c.reading) AS n, c.reading = a.reading AS same, len(list_filter(string_split(c.reading, ' '), lambda w: w <> '')) AS n_clean, a.reading <> c.reading AND lower(a.reading) = lower(c.reading) AS case_only
FROM r c JOIN r a ON a.doc_id = c.doc_id AND a.model = c.model WHERE c.kind = 'clean' AND a.kind = 'adv'""")
def paired_readings(t):
    """JN1: clean and perturbed readings of an image by a model, matched by both."""
    text = F.col("text")
    kinds = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("kind"), x.alias("reading")) for m, k, x in (("m1", "clean", text), ("m1", "adv", F.translate(text, "ae", "ea")), ("m2", "clean", F.lower(text)), ("m2", "adv", text))])
    readings = t.documents.select("doc_id", F.inline(kinds))
    clean, adv = (readings.filter(F.col("kind") == k).select("doc_id", "model", F.col("reading").alias(k)) for k in ("clean", "adv"))
    a, c = F.col("adv"), F.col("clean")
    return clean.join(adv, ["doc_id", "model"]).select(
        "doc_id", "model", F.char_length(c).cast("bigint").alias("n"), (a == c).alias("same"), F.size(F.filter(F.split(c, " "), lambda w: w != "")).cast("bigint").alias("n_clean"),
        ((a != c) & (F.lower(a) == F.lower(c))).alias("case_only"),
    )


@query(f"""WITH p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(r, '\\s+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(h, '\\s+'), lambda x: x <> '') AS b FROM ({PAIRS_SQL}) WHERE h IS NOT NULL)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word, b[i] AS partner FROM (SELECT *, unnest(range(1, least(len(w), len(b)) + 1)) AS i FROM p)""")
def zipped_words(t):
    """JN5: two lists by position, as far as the shorter one goes."""
    rows = pairs(t).select("conv_id", "turn", T.words(F.col("r")).alias("w"), T.words(F.col("h")).alias("b"))
    n = F.least(F.size("w"), F.size("b"))
    both = F.arrays_zip(F.slice("w", F.lit(1), n).alias("w"), F.slice("b", F.lit(1), n).alias("b"))
    return rows.select("conv_id", "turn", F.posexplode(both).alias("pos", "x")).select("conv_id", "turn", "pos", F.col("x.w").alias("word"), F.col("x.b").alias("partner"))


@query("""WITH p AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT conv_id, turn, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) = lower(regexp_replace(trim(nxt), '\\s+', ' ', 'g')) AS same, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS norm FROM p WHERE nxt IS NOT NULL""")
def exact_match(t):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", "text", nxt.alias("nxt")).filter("nxt IS NOT NULL")
    return rows.select("conv_id", "turn", T.exact_match(F.col("text"), F.col("nxt")).alias("same"), T.normalise(F.col("text")).alias("norm"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, left(text, greatest(length(text) - 2, 0)) AS clean FROM conversations), a AS (SELECT *, translate(clean, 'ae', 'ea') AS adv FROM c),
w AS (SELECT conv_id, turn, kind, round({WER_SQL}, 6) AS wer FROM (SELECT conv_id, turn, k.kind, {words_sql('k.reading')} AS h, {words_sql('text')} AS r FROM a, LATERAL (VALUES ('clean', clean), ('adv', adv)) k(kind, reading))),
m AS (SELECT conv_id, turn, round({cer_sql('clean', 'text')}, 6) AS cer_clean, round({cer_sql('adv', 'text')}, 6) AS cer_adv, {NORM_SQL.format('adv')} = {NORM_SQL.format('text')} AS exact_adv, round(greatest(0, 1 - {cer_sql('adv', 'text')}), 6) AS accuracy FROM a)
SELECT m.*, x.wer AS wer_clean, y.wer AS wer_adv, round(cer_adv - cer_clean, 6) AS cer_delta, round(y.wer - x.wer, 6) AS wer_delta FROM m
JOIN w x ON x.conv_id = m.conv_id AND x.turn = m.turn AND x.kind = 'clean' JOIN w y ON y.conv_id = m.conv_id AND y.turn = m.turn AND y.kind = 'adv'""")
def metrics_delta(t):
    """STR6: clean and perturbed readings of each turn; the clean one lacks the
    end, the perturbed one reads a for e and e for a besides."""
    ref = F.col("text")
    clean = F.left(ref, F.char_length(ref) - 2)
    adv = F.translate(clean, "ae", "ea")
    m = [("cer", T.cer), ("wer", T.wer)]
    cols = [F.round(f(x, ref), 6).alias(f"{n}_{k}") for n, f in m for k, x in (("clean", clean), ("adv", adv))]
    rows = t.conversations.select("conv_id", "turn", *cols, T.exact_match(adv, ref).alias("exact_adv"), F.round(T.char_accuracy(adv, ref), 6).alias("accuracy"))
    return rows.withColumn("cer_delta", F.round(F.col("cer_adv") - F.col("cer_clean"), 6)).withColumn("wer_delta", F.round(F.col("wer_adv") - F.col("wer_clean"), 6))


@query("SELECT doc_id, regexp_matches(text, '[O0I1l]') AS ambiguous FROM documents")
def ambiguous_flag(t):
    return t.documents.select("doc_id", T.is_ambiguous(F.col("text")).alias("ambiguous"))


LABELS = ", ".join(f"'{w}'" for w in T.LABEL_WORDS)


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE regexp_matches(w, '[:：#-]$') OR lower(regexp_replace(w, '[:：]+$', '')) IN ({LABELS})) AS n_labels FROM w GROUP BY doc_id""")
def label_words(t):
    """One row is one document, so nothing is shuffled."""
    rows = t.spread("documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.filter(F.size("w") > 0).select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.filter("w", T.is_label)).cast("bigint").alias("n_labels"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE upper(line) = line AND lower(line) <> line AND length(line) < 60 AND NOT contains(line, 'ß')) AS n_slug FROM l GROUP BY doc_id""")
def slug_lines(t):
    rows = t.documents.select("doc_id", F.split("text", "\n").alias("l"))
    return rows.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.size(F.filter("l", T.is_slug_line)).cast("bigint").alias("n_slug"))


#: What stands before and after a turn's text, by its number, for three kinds of clean-up.
SAID = {
    "answer": [("  Assistant \nTranscribe exactly all visible text. Output only the text, nothing else. ", ""), ("", ""), ("ASSISTANT", "  "), ("transcribe exactly all visible text. output only the text, nothing else\n", "")],
    "said": [('The text in the image reads: "', '"'), ("''", "'"), ("the image shows: ", ""), ("The text says ", ' ""')],
    "thought": [("<think>a\nb</think>", ""), ("", "<think></think>"), (" <think>x</think> ", "<think>y"), ("", "")],
}
RAW_CASES = {n: "CASE turn % 4 " + " ".join(f"WHEN {i} THEN '" + a.replace("'", "''") + "' || text || '" + b.replace("'", "''") + "'" for i, (a, b) in enumerate(x)) + " END" for n, x in SAID.items()}


@query(f"""WITH s AS (SELECT conv_id, turn, trim({RAW_CASES['answer']}) AS a, trim({RAW_CASES['said']}) AS s, {RAW_CASES['thought']} AS h FROM conversations), b AS (
SELECT *, trim(regexp_replace(s, '^the (text (in the image )?(reads|is|says)|image (shows|contains|displays|reads))[\\s:"'']*', '', 'i')) AS s1 FROM s)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(a, '^\\s*assistant\\s*', '', 'i'), '^Transcribe exactly all visible text\\. Output only the text, nothing else\\.?\\s*', '', 'i')) AS answer,
trim(regexp_replace(trim(regexp_replace(s1, '^"+|"+$', '', 'g')), '^''+|''+$', '', 'g')) AS said, trim(regexp_replace(h, '<think>.*?</think>', '', 'gs')) AS thought FROM b""")
def clean_prediction(t):
    """STR9, STR10, STR11: what models put around their answers, taken off."""

    def said(kind):
        raw = F.lit(None).cast("string")
        for i, (before, after) in enumerate(SAID[kind]):
            raw = F.when(F.col("turn") % 4 == i, F.concat(F.lit(before), "text", F.lit(after))).otherwise(raw)
        return raw

    return t.conversations.select("conv_id", "turn", T.clean_prediction(said("answer")).alias("answer"), T.strip_preamble(said("said")).alias("said"), T.strip_thoughts(said("thought")).alias("thought"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, replace(replace(lower(url), ' ', ''), '''', '') AS slug FROM pages""")
def html_escape(t):
    return t.pages.select("page_id", T.html_escape(F.col("html")).alias("escaped"), T.slug(F.col("url")).alias("slug"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_id % 3 WHEN 0 THEN 'iMessage' WHEN 1 THEN 'Android Messages' ELSE 'Chat' END AS platform FROM events""")
def json_repair(t):
    note = F.expr("CASE event_id % 3 WHEN 0 THEN '(iOS 17)' WHEN 1 THEN '(on Android)' ELSE '(web)' END")
    raw = F.concat(F.lit('```json\n[{"platform": "Chat" '), note, F.lit(', "p": '), "props", F.lit("}]\n```"))
    parsed = F.from_json(T.unfence(T.repair_json(raw)), "array<struct<platform:string,p:struct<k:bigint>>>")
    return t.events.select("event_id", parsed[0]["p"]["k"].alias("k"), parsed[0]["platform"].alias("platform"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_scan(t):
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return rows.filter("k IS NOT NULL AND k > 50")


@query("""WITH d AS (SELECT doc_id, replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) ELSE '  ' || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || chr(10) END) AS text FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p, text FROM d), f AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS p FROM p)
SELECT doc_id, len(p) AS n_parts, list_max(list_transform(p, lambda x: length(x))) AS longest, p[-1] AS last FROM f""")
def paragraphs(t):
    """STR22: texts whose lines are set apart by blank lines, by none, or by blank
    lines with parts of blanks between them."""
    gap = F.expr("CASE doc_id % 3 WHEN 0 THEN '\\n\\n' WHEN 1 THEN '\\n' ELSE '  \\n\\n  \\n\\n\\n' END")
    parts = t.documents.select("doc_id", T.paragraphs(F.replace("text", F.lit("\n"), gap)).alias("p"))
    return parts.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.array_max(F.transform("p", F.char_length)).cast("long").alias("longest"), F.element_at("p", -1).alias("last"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations), s AS (SELECT conv_id, turn, w, array_to_string(w, ' ') AS text, CAST(len(w) + turn % 3 - 1 AS BIGINT) AS n FROM w),
p AS (SELECT *, unnest(range(0, n)) AS i, (length(text) + 3) // 4 AS tokens FROM s WHERE n > 0), c AS (SELECT *, length(array_to_string(w[:i], ' ')) + CASE WHEN i > 0 THEN 1 ELSE 0 END AS off FROM p)
SELECT conv_id, turn, CAST(i AS INTEGER) AS pos, CAST(CASE WHEN n > len(w) OR conv_id % 7 = 0 THEN i * tokens // n ELSE off // 4 END AS INTEGER) AS first,
CAST(CASE WHEN n > len(w) OR conv_id % 7 = 0 THEN greatest(i * tokens // n + 1, (i + 1) * tokens // n) ELSE (off + length(w[i + 1]) - 1) // 4 + 1 END AS INTEGER) AS stop FROM c""")
def token_alignment(t):
    """STR29, WIN13, JN8, WIN14 chained: tokens are pieces of four characters; a
    turn has a box too few, as many as words, or one too many, and in every
    seventh conversation the first word isn't what is read."""
    rows = t.conversations.select("conv_id", "turn", T.words(F.col("text")).alias("w")).withColumn("text", F.array_join("w", " "))
    read = F.when(F.col("conv_id") % 7 == 0, F.transform("w", lambda x: F.concat(x, F.lit("\u00a7")))).otherwise(F.col("w"))
    starts = F.expr("if(length(text) > 0, sequence(0, cast((length(text) - 1) div 4 * 4 as int), 4), array())").cast("array<int>")
    rows = rows.withColumns({"a": starts, "n": (F.size("w") + F.col("turn") % 3 - 1).cast("int"), "read": read})
    rows = rows.withColumn("b", F.transform("a", lambda x: F.least(x + 4, F.char_length("text"))))
    spans = T.aligned_spans("read", "text", "a", "b", F.greatest("n", F.lit(0)))
    found = rows.select("conv_id", "turn", F.posexplode(spans).alias("pos", "s"))
    return found.select("conv_id", "turn", "pos", F.col("s.start").alias("first"), F.col("s.stop").alias("stop"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, CASE WHEN regexp_matches(text, '\\S') THEN length(regexp_replace(text, '\\s+$', '')) END AS last FROM documents""")
def forward_search(t):
    """Nothing but white space lies between the words of a text, so each is found
    where it stands."""
    rows = t.documents.select("doc_id", T.forward_spans(T.words(F.col("text")), F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("bigint").alias("n"), F.try_element_at("s", F.lit(-1))["stop"].cast("bigint").alias("last"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, flatten(list_transform(w, lambda x: list_transform(range(0, (length(x) + 39) // 40), lambda i: substr(x, CAST(i * 40 + 1 AS BIGINT), 40)))) AS p FROM w)
SELECT doc_id, unnest(string_split(list_reduce(p, lambda a, x: a || CASE WHEN length(string_split(right(a, 41), chr(10))[-1]) + 1 + length(x) <= 40 THEN ' ' ELSE chr(10) END || x), chr(10))) AS line FROM p WHERE len(p) > 0""")
def word_wrap(t):
    return t.documents.select("doc_id", F.explode(T.wrapped(T.words(F.col("text")), 40)).alias("line"))


@query("""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents)
SELECT doc_id, list_filter(w, lambda x: length(x) > 2 AND regexp_matches(x, '^[A-Z]') AND lower(x) NOT IN ('the', 'and', 'der', 'les'))[1] AS word FROM w""")
def first_capitalised(t):
    good = F.expr("try_element_at(filter(w, x -> length(x) > 2 AND x rlike '^[A-Z]' AND lower(x) NOT IN ('the', 'and', 'der', 'les')), 1)")
    return t.documents.select("doc_id", F.split("text", r"\s+").alias("w")).select("doc_id", good.alias("word"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")
def key_title(t):
    return t.part.select("p_partkey", T.key_title(F.col("p_type")).alias("title"))
