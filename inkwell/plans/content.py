"""Content bank: flattening, templating, seeded generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as T
from ..registry import dealt, query


def draw(seed: int, key: str, slot: str, n: int):
    """SMP4: a whole number below ``n`` from the first eight digits of an MD5 of
    seed, key and slot: the same for the same key, in whatever order rows come
    and on whatever engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(slot)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def pick(seed: int, key: str, slot: str, values: list):
    """SMP1-3: one of the values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(seed, key, slot, len(values)) + 1).cast("int"))


def number(seed: int, key: str, slot: str, low: int, high: int):
    return draw(seed, key, slot, high - low + 1) + low


def draw_sql(seed, key, slot, n):
    return f"(CAST('0x' || left(md5('{seed}:' || CAST({key} AS VARCHAR) || ':{slot}'), 8) AS BIGINT) % {n})"


def list_sql(values):
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def pick_sql(seed, key, slot, values):
    return f"{list_sql(values)}[{draw_sql(seed, key, slot, len(values))} + 1]"


def number_sql(seed, key, slot, low, high):
    return f"({draw_sql(seed, key, slot, high - low + 1)} + {low})"


def orders_with_lines(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query("""WITH l AS (SELECT l_orderkey, list(CAST(l_linenumber AS VARCHAR) || ' ' || CAST(l_partkey AS VARCHAR) || ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem GROUP BY ALL)
SELECT o_orderkey, array_to_string(list_filter(list_concat([o_orderpriority, '', ' ', 'Status: ' || o_orderstatus], coalesce(lines, [])), lambda x: trim(x) <> ''), chr(10)) AS full_text FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def flatten_ground_truth(t):
    """STR16, ARR2, FIL14: nested parts to one text, empty parts left out."""
    line = lambda x: F.concat_ws(" ", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_quantity"].cast("int").cast("string"))
    parts = F.concat(F.array("o_orderpriority", F.lit(""), F.lit(" "), F.concat(F.lit("Status: "), "o_orderstatus")), F.coalesce(F.transform("lines", line), F.array().cast("array<string>")))
    return orders_with_lines(t).select("o_orderkey", F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n").alias("full_text"))


@query("""WITH l AS (SELECT l_orderkey, string_agg('<tr><td>' || l_partkey || '</td><td class="' || CASE WHEN l_quantity < 10 THEN 'debit' ELSE 'credit' END || '">' || CAST(l_quantity AS INTEGER) || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_quantity) AS h FROM lineitem GROUP BY ALL)
SELECT o_orderkey, '<h1>' || replace(replace(o_orderpriority, '&', '&amp;'), '<', '&lt;') || '</h1><table>' || coalesce(h, '') || '</table>' AS html FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def html_rows(t):
    """STR23, STR28: rows templated into a table, the sign as a class."""
    sign = lambda x: T.amount_sign(F.when(x["l_quantity"] < 10, "-1").otherwise("+1"), True)
    row = lambda x: F.concat(F.lit("<tr><td>"), x["l_partkey"].cast("string"), F.lit('</td><td class="'), sign(x), F.lit('">'), x["l_quantity"].cast("int").cast("string"), F.lit("</td></tr>"))
    body = F.coalesce(F.array_join(F.transform("lines", row), ""), F.lit(""))
    return orders_with_lines(t).select("o_orderkey", F.concat(F.lit("<h1>"), T.html_escape(F.col("o_orderpriority")), F.lit("</h1><table>"), body, F.lit("</table>")).alias("html"))


@query("""SELECT p_partkey, 'Brand ' || p_brand || '; Size ' || CAST(p_size AS VARCHAR) AS shown FROM part""")
def map_entries(t):
    """MAP1, FIL13, FIL15: map entries with titled keys; private, machine-read
    and empty ones dropped."""
    m = F.create_map(F.lit("brand"), "p_brand", F.lit("_id"), F.lit("x"), F.lit("mrz_1"), F.lit("y"), F.lit("size"), F.col("p_size").cast("string"), F.lit("note"), F.lit(""))
    kept = F.map_filter(m, lambda k, v: ~F.startswith(k, F.lit("_")) & ~F.startswith(k, F.lit("mrz")) & (v != ""))
    shown = F.transform(F.map_entries(kept), lambda e: F.concat(T.key_title(e["key"]), F.lit(" "), e["value"]))
    return t.part.select("p_partkey", F.array_join(shown, "; ").alias("shown"))


def bank(t):
    """A content bank from customers and their orders: seven categories by key,
    some fields empty, blank or absent."""
    o = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))))
    orders = t.orders.groupBy("o_custkey").agg(o.alias("o"))
    rows = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    key = lambda x: x["o_orderkey"].cast("string")
    lists = {"transactions": ("date description amount running_balance".split()), "lab_results": "test value reference_range flag".split(), "parties": ["role", "name"], "clauses": ["number", "heading", "text"], "signature_block": ["role", "name", "date_signed"], "participants": ["role", "name"], "messages": ["sender", "text"]}
    made = {}
    for parts in C.FIELDS.values():
        for part in parts:
            for name in C._names(part):
                made[name] = F.when(F.lit(len(name)) % 3 == F.col("c_custkey") % 3, F.concat(F.lit(f" {name} "), "c_name")).otherwise(F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")))


    def structs(fields: list[str]):
        return F.transform("o", lambda x: F.struct(*[c.alias(n) for n, c in zip(fields, [key(x), x["s"], x["p"], F.lit("")], strict=False)]))

    made |= {name: structs(fields) for name, fields in lists.items()}
    for name in ("medications", "body_paragraphs", "security_features"):
        made[name] = F.transform("o", lambda x: F.concat_ws(" ", key(x), x["p"]))
    made["additional_fields"] = F.create_map(F.lit("height_cm"), F.col("c_nationkey").cast("string"), F.lit("empty"), F.lit(""), F.lit("mrz_line"), F.col("c_mktsegment"))
    category = F.element_at(F.array(*map(F.lit, C.FIELDS)), (F.col("c_custkey") % 7 + 1).cast("int"))
    return rows.select("c_custkey", category.alias("category"), "o", *[v.alias(n) for n, v in made.items()])


def _bank_sql() -> str:
    """The text of each category, spelt out from the same list of fields."""
    field = lambda n: f"CASE WHEN {len(n)} % 3 = c_custkey % 3 THEN '{n} ' || c_name ELSE '' END"
    spaced = lambda n: f"CASE WHEN {len(n)} % 3 = c_custkey % 3 THEN ' {n} ' || c_name WHEN c_custkey % 2 = 0 THEN '  ' ELSE '' END"
    each = lambda x: f"list_transform(o, lambda x: {x})"
    cols = ["CAST(x.k AS VARCHAR)", "x.s", "x.p", "''"]
    out = []
    for k, parts in enumerate(C.FIELDS.values()):
        lists = []
        for part in parts:
            if isinstance(part, str) and "{" in part:
                lists.append(f"[trim('Opening: ' || {spaced('opening_balance')} || ' Closing: ' || {spaced('closing_balance')})]")
            elif isinstance(part, str):
                lists.append(f"[trim({field(part)})]")
            elif part[1] is dict:
                lists.append("[CAST(c_nationkey AS VARCHAR), c_mktsegment]")
            elif part[1] is None:
                lists.append(each("CAST(x.k AS VARCHAR) || ' ' || x.p"))
            else:
                lists.append(each("trim(" + " || ' ' || ".join(cols[: len(part[1])]) + ")"))
        whole = lists[0]
        for x in lists[1:]:
            whole = f"list_concat({whole}, {x})"
        out.append(f"WHEN {k} THEN {whole}")
    return f"""WITH g AS (SELECT o_custkey, list({{'k': o_orderkey, 's': o_orderstatus, 'p': o_orderpriority}} ORDER BY o_orderkey) AS o FROM orders GROUP BY ALL),
r AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, coalesce(o, []) AS o FROM customer LEFT JOIN g ON o_custkey = c_custkey)
SELECT c_custkey, array_to_string(list_filter(CASE c_custkey % 7 {' '.join(out)} END, lambda x: x <> ''), chr(10)) AS full_text FROM r"""


@query(_bank_sql())
def bank_ground_truth(t):
    """STR16: the seven categories of a content bank."""
    return bank(t).select("c_custkey", C.ground_truth(F.col, F.col("category")).alias("full_text"))


@query("""WITH g AS (SELECT o_custkey, list({'k': CAST(o_orderkey AS VARCHAR), 's': o_orderstatus, 'p': o_orderpriority} ORDER BY o_orderkey) AS o FROM orders GROUP BY ALL)
SELECT c_custkey, array_to_string(list_transform(o, lambda x: '<tr><td>' || x.k || '</td><td>' || x.s || '</td><td class="credit">' || x.p || '</td><td></td></tr>'), '') AS transactions,
array_to_string(list_transform(o, lambda x: '<tr><td>' || x.k || '</td><td>' || x.s || '</td><td>' || x.p || '</td><td class="normal"></td></tr>'), '') AS labs, array_to_string(list_transform(o, lambda x: '<li>' || x.k || ' ' || x.p || '</li>'), '') AS items,
array_to_string(list_transform(o, lambda x: '<h3>' || x.k || ' ' || x.s || '</h3><p>' || x.p || '</p>'), '') AS clauses, array_to_string(list_transform(o, lambda x: '<div><span class="role">' || x.k || '</span><span class="name">' || x.s || '</span></div>'), '') AS parties,
array_to_string(list_transform(o, lambda x: '<div class="' || CASE WHEN x.k = o[1].k THEN 'own' ELSE 'other' END || '"><b>' || x.k || '</b><p>' || x.s || '</p></div>'), '') AS bubbles, '<tr><th>Height Cm</th><td>' || c_nationkey || '</td></tr><tr><th>Mrz Line</th><td>' || c_mktsegment || '</td></tr>' AS fields
FROM customer JOIN g ON o_custkey = c_custkey""")
def page_fragments(t):
    """STR23, STR28, JN14: the fragments that pages of the categories are made of."""
    rows = bank(t).filter("o IS NOT NULL")
    return rows.select(
        "c_custkey", C.transaction_rows(F.col("transactions")).alias("transactions"), C.lab_rows(F.col("lab_results")).alias("labs"), C.list_items(F.col("medications")).alias("items"), C.clause_blocks(F.col("clauses")).alias("clauses"),
        C.party_lines(F.col("parties")).alias("parties"), C.bubbles(F.col("messages"), F.col("messages")[0]["sender"]).alias("bubbles"), C.field_rows(F.col("additional_fields")).alias("fields"),
    )


# Patterns by category: %w a word, %c a code, %d a digit, %n a number of four digits.
PATTERNS = {
    "short_structured": [
        "%c%n", "%c-%n", "%c %n", "%d%d%d-%n", "%c%d%d-%c%n", "#%n", "Room %d%d%d", "Gate %c%d", "Seat %d%dA", "Bay %c-%d", "Lot %n", "Unit %d%d/%n", "Ref. %c%n", "No. %n-%d", "Pin %n", "Row %d, %c",
        "%d%d:%d%d", "%d.%d%d EUR", "%n kWh", "%d%d pct", "Exit %d%c", "Locker %n", "v%d.%d.%d", "%c/%n/%d", "Shelf %c%d", "Tray %n", "%n-%n", "Page %d%d", "Zone %c", "Level %d", "Dock %d%d", "Key %c%c%n", "%d%d.%d%d.20%d%d",
        "Tank %d: %n l", "Line %c%d%d", "(%d%d) %n", "Desk %n", "Slot %c%n", "Box %d of %d", "%n %c",
    ],
    "name_entity": [
        "%w %w", "Dr. %w %w", "%w & %w Ltd", "%w %c. %w", "%w Street %d%d", "%w Holdings", "Prof. %w %w", "%w and Sons", "Mt. %w", "The %w Hotel",
        "%w Valley", "%w Road %n", "Port %w", "%w Brothers Inc.", "Lake %w", "St. %w College", "%w-%w Partners", "Cafe %w", "Captain %w", "%w Museum of %w",
    ],
    "natural_phrase": ["Please return the %w by noon.", "The %w is closed on %w days.", "Keep the %w dry.", "Mind the %w.", "Open the %w slowly.", "No %w beyond this point.", "Ask for the %w at the desk.", "All %w must be signed."],
    "semi_structured": [
        "Invoice %c-%n", "Invoice %n: %w", "Room %d%d / %n", "Order %n (%w)", "Ref %c %n, %w", "Ticket %c%n for %w", "Total: %n.%d%d", "Due: 20%d%d-0%d-1%d", "Tel. %n %n", "Status: %w/%c", "Batch %c, item %d%d", "Case %n, page %d",
        "Sent to %w, %d%d items", "Meter %n: %d%d.%d", "%w: %n of %n", "Train %c%d at 1%d:%d%d", "From %w to %w", "Code %c (%w)", "Batch %n by %w", "Weight %d%d.%d kg", "Stock: %n %w", "Flight %c%n, gate %d%d", "Paid %n.%d%d by %w",
        "Version %d.%d (%w)", "Shift %d, %w", "Deposit %n, rate %d.%d", "Size %d%d x %d%d", "Part %c-%d%d, %w", "Valid to 1%d/20%d%d", "Account %n: %w", "Plan %w, tier %d", "Seat %d%d%c, %w", "Lab %c: %d.%d%d", "Row %d, col %d: %n",
        "Dose %d%d mg, %w", "Area %n m2", "Call %n, ask for %w",
    ],
}
WORDS = ["Harbour", "Lantern", "Meadow", "Quartz", "Rowan", "Saffron", "Timber", "Willow", "Ember", "Cobalt"]
CODES = ["AX", "QR", "ZT", "LM", "PK"]
KEYS = ["Name", "ID", "Date", "Ref", "Status", "Code", "Order", "Ticket"]  # Fixed value: keys of a key and value layout.


def composed(seed: int, key: str, slot: str, category: str):
    """STR24: one of the category's patterns, each of its marks filled by a hash."""
    shown = pick(seed, key, f"{slot}/{category}", PATTERNS[category])
    marks = {"%w": lambda i: pick(seed, key, f"{slot}/w{i}", WORDS), "%c": lambda i: pick(seed, key, f"{slot}/c{i}", CODES), "%d": lambda i: number(seed, key, f"{slot}/d{i}", 0, 9).cast("string"), "%n": lambda i: F.lpad(number(seed, key, f"{slot}/n{i}", 1, 9999).cast("string"), 4, "0")}
    for mark, fill in marks.items():
        most = max(p.count(mark) for p in PATTERNS[category])
        if not most:
            continue
        pieces = F.split(shown, mark)
        shown = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.array(F.lit("")), F.array(*[fill(i) for i in range(most)])), lambda p, f: F.when(p.isNotNull(), F.array(f, p)).otherwise(F.array().cast("array<string>")))), "")
    return shown


def composed_sql(seed, key, slot, category):
    """The marks filled one after another, the first that is left each time."""
    shown = pick_sql(seed, key, f"{slot}/{category}", PATTERNS[category])
    fills = {"%w": lambda i: pick_sql(seed, key, f"{slot}/w{i}", WORDS), "%c": lambda i: pick_sql(seed, key, f"{slot}/c{i}", CODES), "%d": lambda i: f"CAST({number_sql(seed, key, f'{slot}/d{i}', 0, 9)} AS VARCHAR)", "%n": lambda i: f"printf('%04d', {number_sql(seed, key, f'{slot}/n{i}', 1, 9999)})"}
    for mark, fill in fills.items():
        for i in range(max(p.count(mark) for p in PATTERNS[category])):
            shown = f"regexp_replace({shown}, '{mark}', {fill(i)})"
    return shown


def kinds_sql(seed, key, kind, slot, kinds):
    return f"CASE {kind} " + " ".join(f"WHEN '{c}' THEN {composed_sql(seed, key, slot, c)}" for c in kinds) + " END"


PLAIN_KINDS, VALUE_KINDS = ["natural_phrase", "semi_structured", "short_structured"], ["name_entity", "short_structured", "semi_structured"]
GEN_SQL = f"""WITH d AS (SELECT c_custkey, [{", ".join(pick_sql(7, "c_custkey", f"kind{i}", PLAIN_KINDS) for i in range(3))}][:{number_sql(7, "c_custkey", "lines", 2, 3)}] AS drawn,
list_transform(list_sort([{", ".join(f"md5('7:' || CAST(c_custkey AS VARCHAR) || ':{k}') || '{k}'" for k in KEYS)}]), lambda x: x[33:]) AS keys FROM customer),
l AS (SELECT c_custkey, drawn, list_filter([{", ".join(kinds_sql(7, "c_custkey", f"drawn[{i + 1}]", f"line{i}", PLAIN_KINDS) for i in range(3))}], lambda x: x IS NOT NULL) AS lines,
[{", ".join(f"keys[{i + 1}] || ': ' || " + kinds_sql(7, "c_custkey", pick_sql(7, "c_custkey", f"value{i}", VALUE_KINDS), f"kv{i}", VALUE_KINDS) for i in range(3))}][:{number_sql(7, "c_custkey", "pairs", 2, 3)}] AS pairs FROM d)
SELECT c_custkey, {", ".join(f'{composed_sql(7, "c_custkey", "one", c)} AS {c}' for c in PATTERNS)}, lines, coalesce(list_filter(drawn, lambda k: len(list_filter(drawn, lambda x: x = k)) > 1)[1], drawn[1]) AS dominant, pairs, regexp_matches(array_to_string(lines, ''), '[O0I1l]') AS ambiguous FROM l"""


def plain_lines(seed: int, key: str):
    """STR25, AGG24: two or three lines of drawn categories, and the one that
    most of them have (the first drawn, if all differ)."""
    kinds = PLAIN_KINDS
    drawn = F.slice(F.array(*[pick(seed, key, f"kind{i}", kinds) for i in range(3)]), F.lit(1), number(seed, key, "lines", 2, 3).cast("int"))
    line = lambda k, i: F.coalesce(*[F.when(k == c, composed(seed, key, f"line{i}", c)) for c in kinds])
    lines = F.filter(F.array(*[line(F.try_element_at(drawn, F.lit(i + 1)), i) for i in range(3)]), lambda x: x.isNotNull())
    most = F.filter(drawn, lambda k: F.size(F.filter(drawn, lambda x: x == k)) > 1)
    return lines, F.coalesce(F.try_element_at(most, F.lit(1)), drawn[0])


def key_value_lines(seed: int, key: str):
    """STR25: two or three different keys, each with a value of a drawn category."""
    kinds = VALUE_KINDS
    shuffled = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(k))).alias("h"), F.lit(k).alias("k")) for k in KEYS]))
    value = lambda i: F.coalesce(*[F.when(pick(seed, key, f"value{i}", kinds) == c, composed(seed, key, f"kv{i}", c)) for c in kinds])
    lines = F.array(*[F.concat(shuffled[i]["k"], F.lit(": "), value(i)) for i in range(3)])
    return F.slice(lines, F.lit(1), number(seed, key, "pairs", 2, 3).cast("int"))


@query(GEN_SQL)
def gen_text(t):
    """STR24, STR25: seeded texts of every category, and texts of several lines."""
    k = "c_custkey"
    lines, most = plain_lines(7, k)
    one = [composed(7, k, "one", c).alias(c) for c in PATTERNS]
    rows = dealt(t.customer).select(k, *one, lines.alias("lines"), most.alias("dominant"), key_value_lines(7, k).alias("pairs"))
    return rows.withColumn("ambiguous", T.is_ambiguous(F.array_join("lines", "")))


def _n(seed, slot, low, high):
    return number_sql(seed, "c_custkey", slot, low, high)


@query(f"""SELECT c_custkey, printf('%03d-%03d  %04d %04d %02d', {_n(3, "bank", 10, 799)}, {_n(3, "branch", 0, 999)}, {_n(3, "a", 1000, 9999)}, {_n(3, "b", 1000, 9999)}, {_n(3, "c", 10, 99)}) AS account,
'****' || CAST({_n(3, "m", 1000, 9999)} AS VARCHAR) AS masked, {pick_sql(3, "c_custkey", "style", ["P", "MR", "PT", "HC"])} || '-' || CAST({_n(3, "p", 100000, 9999999)} AS VARCHAR) AS patient FROM customer""")
def gen_ids(t):
    """STR26: identifiers by hash."""
    # The forms of account and patient numbers.
    k = "c_custkey"
    account = F.format_string("%03d-%03d  %04d %04d %02d", number(3, k, "bank", 10, 799), number(3, k, "branch", 0, 999), number(3, k, "a", 1000, 9999), number(3, k, "b", 1000, 9999), number(3, k, "c", 10, 99))
    patient = F.concat_ws("-", pick(3, k, "style", ["P", "MR", "PT", "HC"]), number(3, k, "p", 100000, 9999999).cast("string"))
    return t.customer.select(k, account.alias("account"), F.concat(F.lit("****"), number(3, k, "m", 1000, 9999).cast("string")).alias("masked"), patient.alias("patient"))


def _p(seed, slot, values):
    return pick_sql(seed, "c_custkey", slot, values)


@query(f"""SELECT c_custkey, CASE WHEN {_n(5, "layout", 0, 99)} < 60 THEN 'single_line' WHEN {_n(5, "layout", 0, 99)} < 80 THEN 'multi_line' ELSE 'key_value' END AS layout, {_p(5, "category", list(PATTERNS))} AS category, {_p(5, "family", ["sans", "serif", "mono"])} AS family,
{_p(5, "size", [18, 26, 36])} AS size, {_n(5, "bold", 0, 99)} < 35 AS bold, {_p(5, "palette", list(range(7)))} AS palette, CASE WHEN {_n(5, "ground", 0, 2)} < 2 THEN 'plain' ELSE 'noisy' END AS background, {_p(5, "width", [1280, 1366, 1440, 1920])} AS width, {_p(5, "height", [720, 768, 900, 1080])} AS height FROM customer""")
def layout_mix(t):
    """SMP1, SMP3, SMP4: sampled specifications of a sample's look."""
    k = "c_custkey"
    share = number(5, k, "layout", 0, 99)
    layout = F.when(share < 60, "single_line").when(share < 80, "multi_line").otherwise("key_value")
    return t.customer.select(
        k, layout.alias("layout"), pick(5, k, "category", list(PATTERNS)).alias("category"), pick(5, k, "family", ["sans", "serif", "mono"]).alias("family"), pick(5, k, "size", [18, 26, 36]).alias("size"), (number(5, k, "bold", 0, 99) < 35).alias("bold"),
        pick(5, k, "palette", list(range(7))).alias("palette"), F.when(number(5, k, "ground", 0, 2) < 2, "plain").otherwise("noisy").alias("background"),
        pick(5, k, "width", [1280, 1366, 1440, 1920]).alias("width"), pick(5, k, "height", [720, 768, 900, 1080]).alias("height"),
    )


# What a page's layout is drawn from.
LAYOUT = {
    "width": [1024, 1152, 1280, 1440], "height": [800, 900, 1024, 1100], "margin_left": [24, 32, 40, 48, 56], "margin_right": [24, 32, 40, 48], "header_h": [44, 52, 60, 68],
    "body_size": [12, 13, 14, 15, 16], "line_spacing": [1.30, 1.40, 1.50, 1.60, 1.75], "para_gap": [8, 10, 12, 16, 20], "font_family": ["sans", "serif", "mono"], "palette": [0, 1, 2, 3],
}
GREY, LABEL_GREY = (15, 35), (90, 130)
GOOD, BAD = ((25, 50), (120, 160), (60, 100)), ((160, 210), (30, 60), (20, 50))


def _colour_sql(name, ranges):
    return "[" + ", ".join(f"CAST({_n(9, f'{name}{i}', *r)} AS INTEGER)" for i, r in enumerate(ranges)) + f"] AS {name}"


def _grey_sql(name, r):
    return "[" + ", ".join([f"CAST({_n(9, name, *r)} AS INTEGER)"] * 3) + f"] AS {name}"


@query(f"""SELECT c_custkey, {", ".join(f"CAST({_p(9, n, v)} AS DOUBLE) AS {n}" if n == "line_spacing" else f"{_p(9, n, v)} AS {n}" for n, v in LAYOUT.items())},
{_grey_sql("text_color", GREY)}, {_grey_sql("label_color", LABEL_GREY)}, {_colour_sql("good_color", GOOD)}, {_colour_sql("bad_color", BAD)} FROM customer""")
def layout_spec(t):
    """SMP2: ten uniform choices and colours within ranges, by category and key."""
    k = "c_custkey"
    colour = lambda name, ranges: F.array(*[number(9, k, f"{name}{i}", *r).cast("int") for i, r in enumerate(ranges)]).alias(name)
    grey = lambda name, r: F.array_repeat(number(9, k, name, *r).cast("int"), 3).alias(name)
    return t.customer.select(k, *[pick(9, k, n, v).alias(n) for n, v in LAYOUT.items()], grey("text_color", GREY), grey("label_color", LABEL_GREY), colour("good_color", GOOD), colour("bad_color", BAD))


def font_of(paths: Column, family: Column, bold: Column, seed: int, key: str) -> Column:
    """SMP5: of ``paths`` (a map of family to files) a bold file of the family if
    wanted and there, else any of the family, else any of the first family that
    has one, else "default"."""
    own = F.coalesce(F.try_element_at(paths, family), F.array().cast("array<string>"))
    heavy = F.filter(own, lambda p: F.contains(F.lower(F.regexp_extract(p, r"([^/]*)$", 1)), F.lit("bold")))
    some = F.when(bold & (F.size(heavy) > 0), heavy).otherwise(own)
    for name in ("sans", "serif", "mono"):
        some = F.when(F.size(some) > 0, some).otherwise(F.coalesce(F.try_element_at(paths, F.lit(name)), some))
    at = draw(seed, key, "font", 1 << 32) % F.greatest(F.size(some), F.lit(1))
    return F.coalesce(F.try_element_at(some, (at + 1).cast("int")), F.lit("default"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_nationkey < 9 THEN 'a/Sans-Bold.ttf' WHEN c_custkey % 4 = 1 THEN 'a/Serif.ttf' ELSE ['a/Sans.ttf', 'a/Sans-Bold.ttf'][{draw_sql(3, "c_custkey", "font", 1 << 32)} % 2 + 1] END AS font FROM customer""")
def font_pick(t):
    """SMP5: families with a bold file and without one, and two that have none."""
    paths = F.create_map(F.lit("sans"), F.array(F.lit("a/Sans.ttf"), F.lit("a/Sans-Bold.ttf")), F.lit("serif"), F.array(F.lit("a/Serif.ttf")))
    family = F.element_at(F.array(*map(F.lit, ("sans", "serif", "mono", "script"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", font_of(paths, family, F.col("c_nationkey") < 9, 3, "c_custkey").alias("font"))
