"""Quality rules, line first: judge each line, remove failures, then reject documents that lose too much.

Cases: null or empty text has no words, so the base rule (fewer than 50 words) rejects it. Lines without a word
are never judged. Repeated rows are judged alike, row by row; other columns of the input, whatever their names, play no
part, and clean keeps them. Very long texts are judged whole. A document that loses just the limit stays. Empty tables
give no row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.llm.common import doc_texts, map_rows

SYMBOLS = "#*$%&|<>"
#: A line of at most fragment_words words that ends otherwise is a heading, a menu entry or a fragment.
TERMINAL = ".!?:;…\"'”’»)]。！？"
NAVIGATION = "|»›>•·"
#: Phrases of menus, notices and licences, by language.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "copyright (c)", "enable javascript", "licensed under", "lorem ipsum", "privacy policy", "released under", "share this", "sign in", "sign up", "subscribe to", "terms of service", "terms of use",
    "accepter les cookies", "cliquez ici", "conditions générales", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "nutzungsbedingungen",
    "aceptar cookies", "aviso legal", "haga clic aquí", "política de privacidad", "términos de uso", "todos los derechos reservados",
    "©",
)
_SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    fragment_words: int = 4
    max_symbol_percent: int = 10
    navigation_marks: int = 3
    max_removed_percent: int = 50


def line_fails(line: str, rules: LineRules = LineRules()) -> bool:
    """The rules for one line that has a word: boilerplate, navigation, symbols, missing end punctuation."""
    words = line.encode("utf-8", "surrogatepass").split()
    low = line.lower()
    if any(phrase in low for phrase in BOILERPLATE) and len(words) <= 30:
        return True
    if sum(map(line.count, NAVIGATION)) >= rules.navigation_marks and 8 * sum(map(line.count, NAVIGATION)) >= len(words):
        return True
    chars = len(line) - sum(map(line.count, _SPACE))
    if 100 * sum(map(line.count, SYMBOLS)) > rules.max_symbol_percent * chars:
        return True
    return len(words) <= rules.fragment_words and line.rstrip(_SPACE)[-1] not in TERMINAL


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n, covered = 0, 0
    for at, w in enumerate(windows):
        if seen[w] > 1:
            n += at + 3 - max(covered, at)
            covered = at + 3
    return n


def judge(text: str, rules: LineRules = LineRules()) -> tuple[tuple, str]:
    """The digest columns after doc_id, and the text without its failing lines."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACE))
    seen: set[str] = set()
    dups = removed = removed_words = 0
    kept_lines = []
    for line in text.split("\n"):
        if not line or not line.strip(_SPACE):
            kept_lines.append(line)
            continue
        dups += line in seen
        seen.add(line)
        if line_fails(line, rules):
            removed += 1
            removed_words += len(line.encode("utf-8", "surrogatepass").split())
        else:
            kept_lines.append(line)
    repeats = repeat_words(words)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    kept = not failed and 100 * removed_words <= rules.max_removed_percent * len(words)
    symbols = sum(map(text.count, SYMBOLS))
    return (len(words), chars, symbols, dups, repeats, failed, kept, removed, removed_words), "\n".join(kept_lines)


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of docs: base measures, verdict, and what the line rules removed."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def per_slice(batch: pa.RecordBatch) -> dict:
        rows = [judge(t, rules)[0] for t in batch.column(1).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
        return dict(zip(names, [batch.column(0), *cols], strict=True))

    return map_rows(doc_texts(docs), per_slice, SCHEMA)


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, without their failing lines, in the columns of docs."""

    def per_slice(batch: pa.RecordBatch) -> dict:
        got = [judge(t, rules) for t in batch.column(1).to_pylist()]
        return {"row": batch.column(0), "kept": [g[0][6] for g in got], "clean": [g[1] for g in got]}

    # the row itself rides along as a struct, so no join brings it back
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    row_type = packed.schema["row"].dataType.simpleString()
    out = map_rows(packed, per_slice, f"row {row_type}, kept boolean, clean string").filter("kept")
    return out.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
