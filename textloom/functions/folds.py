"""The foldings of ``text`` and the words of ``tokens`` for Python functions over Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from textloom.functions.text import FOLD_FROM, FOLD_TO, MULTI_FOLD

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_FOLD = {ord(a): FOLD_TO[k] if k < len(FOLD_TO) else None for k, a in reversed(list(enumerate(FOLD_FROM)))} | {ord(a): b for a, b in MULTI_FOLD.items()}
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_OTHERS = bytes(c for c in range(256) if c > 127 or not chr(c).isalnum())
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


class Folded(dict):
    """Runs of non-ASCII characters to what they fold to; bounded."""

    def __missing__(self, run: str) -> str:
        made = run.translate(_FOLD)
        if len(run) <= 16:
            if len(self) >= 50_000:
                self.clear()
            self[run] = made
        return made


def fold(text: str, folded: Folded) -> str:
    """``ascii_fold``."""
    return text if text.isascii() else _FOREIGN.sub(lambda m: folded[m.group()], text)


def words(lowered: str, folded: Folded) -> list[str]:
    """``plain_words`` of a text in lower case."""
    return fold(lowered, folded).encode().translate(None, _PUNCTUATION).decode().split()


def letters(text: str, folded: Folded) -> str:
    """The folded letters and digits in lower case, of which ``trigram_set`` makes trigrams."""
    return fold(text, folded).encode().translate(_LOWER, _OTHERS).decode()


def bounded(rows: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes."""
    if BATCH not in rows.sparkSession.conf.getAll:
        rows.sparkSession.conf.set(BATCH, "4m")
    return rows.mapInArrow(run, schema)
