"""Content items: their schema, ground truth, fragments of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import amount_sign, html_escape, key_title

# The fields of an item by category, in the order in which they make
# its ground truth. A pair is a list of structs with the fields that are joined by
# blanks, or of strings; braces are filled in.
FIELDS: dict[str, list] = {
    "banking": [
        "bank_name", "account_holder", "account_number", "account_type", "statement_period", "Opening: {opening_balance} Closing: {closing_balance}",
        ("transactions", ["date", "description", "amount", "running_balance"]), "summary_note",
    ],
    "medical": [
        "hospital_name", "patient_name", "dob", "patient_id", "visit_date", "attending_physician", "chief_complaint", "diagnosis",
        ("medications", None), ("lab_results", ["test", "value", "reference_range", "flag"]), "clinical_notes", "follow_up",
    ],
    "news": ["outlet_name", "headline", "byline", "dateline", "category_tag", "lead_paragraph", ("body_paragraphs", None), "pull_quote"],
    "copyright": ["title", "author", "publisher", "copyright_line", "chapter_or_scene", "content"],
    "legal": [
        "title", "document_type", "jurisdiction", "date", "case_or_ref_number",
        ("parties", ["role", "name"]), ("clauses", ["number", "heading", "text"]), ("signature_block", ["role", "name", "date_signed"]), "notary_note",
    ],
    "identity": [
        "document_type", "issuing_authority", "surname", "given_names", "dob", "document_number", "nationality_or_state", "issue_date", "expiry_date",
        ("additional_fields", dict), ("security_features", None),
    ],
    "communications": ["comm_type", "platform", "subject", "timestamp", "thread_context", ("participants", ["role", "name"]), ("messages", ["sender", "text"])],
}


def _names(part) -> list[str]:
    if isinstance(part, str):
        return [x.split("}")[0] for x in part.split("{")[1:]] if "{" in part else [part]
    return [part[0]]


def item_schema() -> str:
    """DDL of an item of any category: every field that one of them has."""
    kinds: dict[str, str] = {}
    for parts in FIELDS.values():
        for part in parts:
            for name in _names(part):
                if isinstance(part, str):
                    kinds[name] = "string"
                elif part[1] is None:
                    kinds[name] = "array<string>"
                elif part[1] is dict:
                    kinds[name] = "map<string,string>"
                else:
                    kinds[name] = f"array<struct<{','.join(f'{x}:string' for x in part[1])}>>"
    return ", ".join(f"{k} {v}" for k, v in kinds.items())


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def ground_truth(item, category: Column) -> Column:
    """STR16, FIL14, ARR2: the text of an item, its parts by line in the order of
    its category, empty parts left out; null for an unknown category. ``item``
    gives the column of a field. A field that is null counts as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    none = F.array().cast("array<string>")

    def parts(part) -> Column:
        if isinstance(part, str) and "{" in part:
            pieces: list[Column] = []
            for i, x in enumerate(part.split("{")):
                name, rest = x.split("}") if i else (None, x)
                pieces += [text(item(name))] if name else []
                pieces.append(F.lit(rest))
            return F.array(F.concat(*pieces))
        if isinstance(part, str):
            return F.array(text(item(part)))
        name, fields = part
        if fields is None:
            return F.coalesce(item(name), none)
        if fields is dict:
            return F.coalesce(F.filter(F.map_values(item(name)), lambda v: F.coalesce(v, F.lit("")) != ""), none)
        return F.coalesce(F.transform(item(name), lambda x: F.concat_ws(" ", *[text(x[f]) for f in fields])), none)

    def whole(category: str) -> Column:
        lines = F.transform(F.concat(*[parts(p) for p in FIELDS[category]]), lambda x: stripped(F.coalesce(x, F.lit(""))))
        return F.array_join(F.filter(lines, lambda x: x != ""), "\n")

    return reduce(lambda c, k: c.when(category == k, whole(k)), list(FIELDS)[1:], F.when(category == "banking", whole("banking")))


# STR23: fragments of pages. Each takes the array that it renders; texts are escaped.


def _each(items: Column, row) -> Column:
    return F.coalesce(F.array_join(F.transform(items, row), ""), F.lit(""))


def _cell(x: Column, name: str = "td", kind: str | Column = "") -> Column:
    mark = F.lit(f' class="{kind}"' if kind else "") if isinstance(kind, str) else F.concat(F.lit(' class="'), kind, F.lit('"'))
    return F.concat(F.lit(f"<{name}"), mark, F.lit(">"), html_escape(F.coalesce(x.cast("string"), F.lit(""))), F.lit(f"</{name}>"))


def transaction_rows(items: Column) -> Column:
    """Banking: a table row for each transaction, the amount marked by its sign."""
    return _each(items, lambda x: F.concat(F.lit("<tr>"), _cell(x["date"]), _cell(x["description"]), _cell(x["amount"], "td", amount_sign(x["amount"], True)), _cell(x["running_balance"]), F.lit("</tr>")))


def lab_rows(items: Column) -> Column:
    """Medical: a table row for each result, marked if its flag is not normal."""
    flag = lambda x: F.when(F.upper(F.coalesce(x["flag"], F.lit(""))).isin("", "N", "NORMAL"), "normal").otherwise("flagged")
    return _each(items, lambda x: F.concat(F.lit("<tr>"), _cell(x["test"]), _cell(x["value"]), _cell(x["reference_range"]), _cell(x["flag"], "td", flag(x)), F.lit("</tr>")))


def list_items(items: Column) -> Column:
    """Medications, security features, tags."""
    return _each(items, lambda x: _cell(x, "li"))


def paragraph_blocks(items: Column) -> Column:
    """News, books: a paragraph for each text."""
    return _each(items, lambda x: _cell(x, "p"))


def clause_blocks(items: Column) -> Column:
    """Legal: number and heading, then the text."""
    return _each(items, lambda x: F.concat(_cell(F.concat_ws(" ", x["number"], x["heading"]), "h3"), _cell(x["text"], "p")))


def party_lines(items: Column) -> Column:
    """Legal, participants: role and name."""
    return _each(items, lambda x: F.concat(F.lit("<div>"), _cell(x["role"], "span", "role"), _cell(x["name"], "span", "name"), F.lit("</div>")))


def field_rows(entries: Column) -> Column:
    """Identity: a row for each entry of a map with a value, its key in title form."""
    some = F.filter(F.map_entries(entries), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return _each(some, lambda e: F.concat(F.lit("<tr>"), _cell(key_title(e["key"]), "th"), _cell(e["value"]), F.lit("</tr>")))


def bubbles(items: Column, own: Column) -> Column:
    """JN14: messages, those of ``own`` marked."""
    side = lambda x: F.when(x["sender"] == own, "own").otherwise("other")
    return _each(items, lambda x: F.concat(F.lit('<div class="'), side(x), F.lit('">'), _cell(x["sender"], "b"), _cell(x["text"], "p"), F.lit("</div>")))


def page(item, category: Column) -> Column:
    """STR23: an item as a page of its category: a heading, then its fragments;
    null for an unknown category. ``item`` gives the column of a field."""
    table = lambda rows: F.concat(F.lit("<table>"), rows, F.lit("</table>"))
    group = lambda name, rows: F.concat(F.lit(f"<{name}>"), rows, F.lit(f"</{name}>"))
    line = lambda *names: F.concat(*[_cell(item(n), "p") for n in names])
    own = F.coalesce(F.try_element_at(F.filter(item("participants"), lambda p: p["role"] == "self"), F.lit(1))["name"], F.try_element_at(item("participants"), F.lit(1))["name"])
    made = {
        "banking": ("bank_name", [line("account_holder", "account_number", "statement_period"), table(transaction_rows(item("transactions"))), line("summary_note")]),
        "medical": ("hospital_name", [line("patient_name", "patient_id", "diagnosis"), group("ul", list_items(item("medications"))), table(lab_rows(item("lab_results"))), line("clinical_notes")]),
        "news": ("headline", [line("byline", "dateline", "lead_paragraph"), paragraph_blocks(item("body_paragraphs")), _cell(item("pull_quote"), "blockquote")]),
        "copyright": ("title", [line("author", "publisher", "copyright_line"), _cell(item("chapter_or_scene"), "h2"), line("content")]),
        "legal": ("title", [line("document_type", "jurisdiction", "case_or_ref_number"), party_lines(item("parties")), clause_blocks(item("clauses")), line("notary_note")]),
        "identity": ("document_type", [line("issuing_authority", "surname", "given_names", "document_number"), table(field_rows(item("additional_fields"))), group("ul", list_items(item("security_features")))]),
        "communications": ("platform", [line("subject", "timestamp"), party_lines(item("participants")), bubbles(item("messages"), own)]),
    }

    def whole(category: str) -> Column:
        title, parts = made[category]
        return F.concat(F.lit(f'<article class="{category}">'), _cell(item(title), "h1"), *parts, F.lit("</article>"))

    return reduce(lambda c, k: c.when(category == k, whole(k)), list(made)[1:], F.when(category == "banking", whole("banking")))
