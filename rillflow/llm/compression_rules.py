"""Quality rules: word and line counts, and compression bands.

The zstandard ratio (bytes / compressed bytes) of a whole document must lie within limits for its length, and so must
the ratios of its fixed chunks, by the chunk's length: repetitive text compresses too well, and random or encoded text hardly
at all. A few chunks beyond their limits are enough to reject, fewer of them the longer the text. The least ratios lie
between what random base64 or alphanumeric words reach at the lengths of a row (1.26 at 500 bytes, 1.41 at most) and what
prose does from its first length on; below 256 bytes the two overlap, and random text is not told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import pieces, small_batches, texts_of
from .words import PLAIN, _groups, windows

LEVEL = 3
#: (bytes from, least ratio, largest ratio) of whole documents; the last row whose length is reached holds.
BANDS = [
    (0, 0.6, 2.0), (64, 0.8, 3.0), (128, 0.9, 3.0), (256, 1.17, 3.0), (300, 1.2, 3.0), (350, 1.22, 3.0), (400, 1.25, 3.0), (450, 1.27, 3.0), (500, 1.29, 3.0), (600, 1.31, 3.0), (700, 1.34, 3.0),
    (850, 1.36, 3.0), (1024, 1.39, 3.5), (1500, 1.42, 3.5), (2048, 1.46, 3.5), (4096, 1.5, 4.0), (16384, 1.55, 5.0), (131072, 1.55, 8.0),
]
#: Bytes of a chunk; what is left at the end is a chunk of its own from CHUNK_LEAST bytes on, and else part of the last one.
CHUNK, CHUNK_LEAST = 4096, 512
#: (bytes from, least ratio, largest ratio) of chunks. Prose has 1.5 to 3.9 in chunks of 4096 bytes.
CHUNK_BANDS = [(0, 0.6, 4.0), (512, 1.29, 4.0), (700, 1.34, 4.0), (1024, 1.39, 4.5), (2048, 1.46, 4.5), (4096, 1.5, 4.5)]
#: (bytes of the text from, largest share of its bytes in chunks beyond their limits).
CHUNK_SHARES = [(0, 0.1), (1 << 17, 0.05)]
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_SYMBOL = bytes(b for b in range(256) if chr(b) not in "#*$%&|<>")
_IS_CONTINUATION = bytes(range(0x80, 0xC0))


def chunks_of(raw: bytes) -> list[bytes]:
    """The whole text in chunks."""
    starts = list(range(0, len(raw), CHUNK))
    if len(starts) > 1 and len(raw) - starts[-1] < CHUNK_LEAST:
        starts.pop()
    return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)] if raw else []


def ratios(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Ratio of the whole text, and (bytes, ratio) of each chunk."""
    whole = len(raw) / len(packer.compress(raw)) if raw else 0.0
    parts = chunks_of(raw)
    return whole, [(len(raw), whole)] if len(parts) == 1 else [(len(part), len(part) / len(packer.compress(part))) for part in parts]


def limits(table: list[tuple], n_bytes: int) -> tuple:
    return next(row[1:] for row in reversed(table) if n_bytes >= row[0])


def in_bands(whole: float, chunks: list[tuple[int, float]]) -> bool:
    n_bytes = sum(n for n, _ in chunks)
    least, most = limits(BANDS, n_bytes)
    if not least <= whole <= most:
        return False
    beyond = 0
    for n, ratio in chunks:
        least, most = limits(CHUNK_BANDS, n)
        beyond += n * (not least <= ratio <= most)
    return beyond <= limits(CHUNK_SHARES, n_bytes)[0] * n_bytes


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = raw.split(b"\n")
    if len(lines) == 1:
        return 0
    full = [x for x in lines if x.strip(_SPACE)]
    return len(full) - len(set(full))


def repeated_words(h: np.ndarray, size: int = 5) -> int:
    """Words within runs of ``size`` words that occur twice or more."""
    if len(h) < size:
        return 0
    runs = windows(h, size)
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    reach = np.zeros(len(h) + 1, np.int64)
    reach[: len(runs)] += twice
    reach[size : size + len(runs)] -= twice
    return int((np.cumsum(reach)[:-1] > 0).sum())


class QualityRules:
    """Counts words, symbols and repeats, and checks compression bands.

    ``judge`` gives a row per document row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ``base_failed`` (fewer than 10 words, or over 20 % of them in repeated 5-word runs), ``kept``, ``ratio`` and
    ``n_chunks``. Null and empty texts have no words and fail. Repeated rows are alike; other columns are ignored; an
    empty table gives no rows. Long texts are read whole, to the last chunk; a ratio equal to a limit is within it.
    Nothing is learned, so a row's outcome depends on its text alone.
    """

    def judge(self, docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
        small_batches(docs.sparkSession)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

        def run(batches):
            packer = zstandard.ZstdCompressor(level=LEVEL)
            for batch in pieces(batches):
                texts = texts_of(batch, "text")
                rows, kept, failed, whole, chunks = [], [], [], [], []
                at = 0
                for h, cut in _groups(texts, PLAIN):
                    for i in range(len(cut) - 1):
                        raw, own = texts[at], h[cut[i] : cut[i + 1]]
                        at += 1
                        n, again = len(own), repeated_words(own)
                        rows.append((n, len(raw.translate(None, _SPACE + _IS_CONTINUATION)), len(raw.translate(None, _NOT_SYMBOL)), duplicate_lines(raw), again))
                        failed.append(n < 10 or 100 * again > 20 * n)
                        ratio, parts = ratios(raw, packer)
                        whole.append(ratio), chunks.append(len(parts))
                        kept.append(not failed[-1] and in_bands(ratio, parts))
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(whole, pa.float64()), pa.array(chunks, pa.int64())], [id_, *names, "base_failed", "kept", "ratio", "n_chunks"])

        schema = T.StructType([T.StructField(id_, docs.schema[id_].dataType), *[T.StructField(n, T.LongType()) for n in names], *[T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")], T.StructField("ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType())])
        return docs.select(F.col(id_), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
