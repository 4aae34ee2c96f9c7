"""Line-first cleaning: rules for single lines, then for what is left of the document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import KINDS, U64, mix, raw, slices, words

SYMBOLS = b"#*$%&|<>"
#: what lines of running text end with, before closing quotes or brackets
TERMINAL = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
#: the end of a sentence within a line
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s|[。！？]")
#: words that stand between the parts of menus and trails
SEPARATORS = frozenset("|»›>•·")
#: phrases of page furniture in four languages, in lower case
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "accept cookies", "javascript is", "javascript must be",
    "lorem ipsum", "click here", "subscribe to our", "sign up for our", "share on facebook", "share on twitter", "skip to content", "skip to main content", "back to top", "powered by",
    "tous droits réservés", "mentions légales", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "cliquez ici", "inscrivez-vous à", "partager sur", "aller au contenu", "haut de page",
    "alle rechte vorbehalten", "impressum", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken", "klicken sie hier", "newsletter abonnieren", "teilen auf", "zum inhalt springen", "nach oben",
    "todos los derechos reservados", "aviso legal", "términos de uso", "política de privacidad", "aceptar cookies", "haga clic aquí", "suscríbete a", "compartir en", "saltar al contenido", "volver arriba",
)
CODE = re.compile(r"[{}]|</?\w+[^>]*>")
_SIGNS = re.compile(r"[#*$%&|<>»›•·{}]")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def line_fails(line: str, *, max_symbol_share: float = 0.1, max_shout_share: float = 0.6, max_repeat_share: float = 0.5, min_unended_words: int = 12) -> str | None:
    """The name of the rule by which a line goes, or None if it stays. Lines without words stay.

    A line must end like running text. One that doesn't stays only if it has at least ``min_unended_words`` words and
    a sentence ends within it, as in text that was cut off or wrapped. Time and memory follow the line's length.
    """
    found = line.split()
    n = len(found)
    if not n:
        return None
    if _SIGNS.search(line):
        parts = sum(map(SEPARATORS.__contains__, found))
        if parts >= 2 and 5 * parts >= n:  # three or more parts of few words
            return "navigation"
        if CODE.search(line):
            return "code"
        if sum(1 for w in found if _SYMBOL.search(w)) > max_symbol_share * n:
            return "symbols"
    lower = line.lower()
    if any(x in lower for x in BOILERPLATE):
        return "boilerplate"
    if n >= 4:
        if max(Counter(found).values()) > max_repeat_share * n:
            return "repeats"
        if sum(map(str.isupper, found)) > max_shout_share * n or "!!" in line and sum(w.endswith("!!") for w in found) > max_shout_share * n:
            return "shouting"
    if not TERMINAL.search(line.rstrip()) and (n < min_unended_words or not SENTENCE.search(line)):
        return "punctuation"
    return None


def clean_lines(text: str | None, **options) -> tuple[str, float]:
    """What is left of a text without its failed lines, and the share of its word characters that went."""
    kept, total, lost = [], 0, 0
    for line in (text or "").split("\n"):
        n = sum(map(len, line.split()))
        total += n
        if line_fails(line, **options) is None:
            kept.append(line)
        else:
            lost += n
    return "\n".join(kept), lost / total if total else 0.0


def _base(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of :func:`line_quality` for each row, without a Python loop over words."""
    w = words(column, "space", lower=False)
    rows = len(column)
    data, (bytes_, offsets) = w.data, raw(column)
    first = w.first
    lead = (data < 0x80) | (data >= 0xC0)  # one byte of each character
    inside = KINDS["space"][data]
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.diff(first), "word_chars": per_row(lead & inside), "n_symbols": per_row(symbol[data])}

    # Words of 3-word windows that the row has twice or more
    repeat = np.zeros(len(w.hash) + 1, np.int64)
    if len(w.hash) > 2:
        at = np.flatnonzero(w.row[:-2] == w.row[2:])
        key = mix(mix(mix(w.hash[at]) + w.hash[at + 1] * U64(3)) + w.hash[at + 2] * U64(5) + w.row[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        placed = key[order]
        same = placed[1:] == placed[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = at[twice]
        np.add.at(repeat, hit, 1)
        np.add.at(repeat, hit + 3, -1) if len(hit) and hit[-1] + 3 <= len(w.hash) else None
    covered = np.cumsum(repeat)[: len(w.hash)] > 0
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows) if len(w.hash) else np.zeros(rows, np.int64)

    # Lines: from a row's start or after \n, up to \n or the row's end
    newline = data == 0x0A
    starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(newline) + 1]))
    starts = starts[starts < len(data)]
    dup = np.zeros(rows, np.int64)
    if len(starts):
        ends = np.append(starts[1:], len(data))
        ends = ends - newline[ends - 1]
        line_row = np.searchsorted(offsets, starts, side="right") - 1
        some = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
        starts, ends, line_row = starts[some], ends[some], line_row[some]
        seen: set = set()
        now = -1
        body = data.tobytes()
        for r, a, b in zip(line_row.tolist(), starts.tolist(), ends.tolist()):
            if r != now:
                seen, now = set(), r
            line = body[a:b]
            if line in seen:
                dup[r] += 1
            else:
                seen.add(line)
    out["n_dup_lines"] = dup
    return out


def _judge(max_lost: float, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for low, high in slices(text):
                part = text.slice(low, high - low)
                base = _base(part)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                cleaned = [clean_lines(x, **options) for x in part.to_pylist()]
                lost = np.array([x[1] for x in cleaned])
                kept = ~failed & (lost <= max_lost)
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                yield pa.record_batch(
                    [key.slice(low, high - low), *[pa.array(base[n], pa.int64()) for n in names], pa.array(failed), pa.array(kept), pa.array(lost), pa.array([x[0] for x in cleaned], pa.string())],
                    ["key", *names, "base_failed", "kept", "lost_share", "cleaned"],
                )

    return run


def line_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.3, **options) -> DataFrame:
    """For each row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_share, cleaned.

    Lines fail by the rules of :func:`line_fails` and leave ``cleaned``; a document that loses more than
    ``max_lost`` of its word characters so is not kept. ``base_failed`` (under 50 words, or over half of the
    words in 3-word windows that come twice) means not kept too. A null text counts as empty: no words,
    so base_failed. Ids may be null or repeat, each row is judged alone; other columns don't matter; an
    empty table gives no rows. It is one pass without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_share double, cleaned string"
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_judge(max_lost, options), schema).withColumnRenamed("key", id_col)
