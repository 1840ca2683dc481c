"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in the order that a model is trained on.

The code points of a batch of texts are sorted into character classes, kept as a wavelet matrix of LEVELS bit vectors with
counts. The units of a cut (code points, words, sentences, lines) end at characters of some of the classes, so
the number of units before a place is a sum of ranks of these classes, and the place where the k-th unit ends is found by bisection on that sum,
for all texts of the batch at once. Nothing is shuffled: texts are cut where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: In a hundred: texts that stay plain are those from TRANSFORMED on; of the others SPM have the suffix first.
TRANSFORMED, SPM = 90, 20
#: Code points whose wavelet matrix is made at once; a longer text has one of its own.
BLOCK = 1 << 20
LEVELS = 3
# Character classes: bits 0 and 1 are the kind (word, space, sentence mark, line end), bit 2 is set on the last character before white space or the end.
WORD, SPACE, MARK, LINE, LAST = 0, 1, 2, 3, 4
_EVERY = tuple(range(1 << LEVELS))
#: Unit -> classes whose characters end one. What follows the last such character of a text is a unit as well.
UNITS = {"character": _EVERY, "word": (WORD | LAST, MARK | LAST), "sentence": (MARK | LAST,), "line": (LINE, LINE | LAST)}
_KINDS = np.zeros(128, np.uint8)
_KINDS[list(b"\t\x0b\x0c\r ")], _KINDS[list(b".!?")], _KINDS[10] = SPACE, MARK, LINE


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each code point of texts laid end to end; ends are the places after each text that isn't empty."""
    kind = np.where(points < 128, _KINDS[np.minimum(points, 127)], WORD).astype(np.uint8)
    blank = (kind == SPACE) | (kind == LINE)
    after = np.append(blank[1:], True)
    after[ends - 1] = True
    return kind | np.where(after, LAST, 0).astype(np.uint8)


class WaveletMatrix:
    """Ranks over a string of symbols below 2 ** levels, one bit vector for each bit from the highest."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def ones(self, depth: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[depth][word] + np.bitwise_count(self.bits[depth][word] & low)

    def count(self, wanted: tuple[int, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many symbols in [start, end) are among the wanted ones: their ranks, added up; a branch that is wanted as a whole is counted at its root."""

        def below(depth: int, found: tuple[int, ...], a: np.ndarray, z: np.ndarray) -> np.ndarray:
            if len(found) == 1 << (self.levels - depth):
                return z - a
            half = 1 << (self.levels - depth - 1)
            total, ones_a, ones_z = np.zeros_like(a), self.ones(depth, a), self.ones(depth, z)
            if low := tuple(s for s in found if not s & half):
                total = total + below(depth + 1, low, a - ones_a, z - ones_z)
            if high := tuple(s & ~half for s in found if s & half):
                total = total + below(depth + 1, high, self.zeros[depth] + ones_a, self.zeros[depth] + ones_z)
            return total

        return below(0, tuple(sorted(set(wanted))), start, end)

    def after_unit(self, wanted: tuple[int, ...], start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The first place in [start, end] with k wanted symbols between start and it; end where there are fewer."""
        low, high = start.copy(), end.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(wanted, start, middle) >= k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def choice(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 from the seed and the id alone, so a text is cut alike wherever and whenever it is read."""
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(made[k : k + 4], "big") for k in (0, 4, 8, 12))


def placed(texts: list[str], chosen: list[tuple[int, int, int, int]], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut) of each text, the cuts in code points: after the smaller and the larger of the first two numbers modulo units + 1."""
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = classes(points, end[sizes > 0])
    tree, wanted = WaveletMatrix(symbols), UNITS[unit]
    n = tree.count(wanted, start, end)
    # A unit that the text's end cuts off counts as well.
    n += (sizes > 0) & ~np.isin(symbols[np.maximum(end - 1, 0)] if len(symbols) else np.zeros(len(texts), np.uint8), wanted)
    h = np.array([c[:2] for c in chosen], np.int64).reshape(-1, 2) % (n + 1)[:, None]
    cuts = [tree.after_unit(wanted, start, end, k) - start for k in (h.min(axis=1), h.max(axis=1))]
    return n, cuts[0], cuts[1]


def transformed(text: str, form: str, a: int, b: int) -> str:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else text


def restored(output: str, form: str) -> str:
    """The text from its output: no mark can stand across the end of a part, so each is found where it was put."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output[len(one) :].split(two, 1)
    second, middle = rest.split(MIDDLE, 1)
    return first + middle + second if form == "psm" else second + middle + first


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def grouped(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of up to `block` code points, or of one longer text."""
    for b in batches:
        ids, texts, held = [], [], 0
        for k in range(b.num_rows):
            text = b.column(1)[k].as_py() or ""
            if texts and held + len(text) > block:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(b.column(0)[k].as_py())
            texts.append(text)
            held += len(text)
        if texts:
            yield ids, texts


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "character", seed: int = 1, with_output: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n (units), form (psm, spm or plain), prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    unit: character, word, sentence or line; cuts fall after whole units. A null text is an empty one and plain, as is a text that holds a mark.
    Repeated rows are cut alike; a null id is hashed as no digits. An empty table gives no row. Other columns are not read. Whole texts are cut, however long.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in grouped(batches, block):
            chosen = [choice(i, seed) for i in ids]
            out = []
            for i, text, (_, _, h3, h4), n, a, b in zip(ids, texts, chosen, *(x.tolist() for x in placed(texts, chosen, unit)), strict=True):
                plain = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED
                form = "plain" if plain else "spm" if h4 % 100 < SPM else "psm"
                made = transformed(text, form, a, b)
                out.append((i, n, form, None if plain else a, None if plain else b - a, made if with_output else None, digest(made), digest(restored(made, form))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    read = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return read.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), with_output=False).drop("output")


OP12_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents
), drawn AS (
    SELECT doc_id, t, n, cast('0x' || substr(h, 1, 8) AS bigint) % (n + 1) AS p, cast('0x' || substr(h, 9, 8) AS bigint) % (n + 1) AS q,
        cast('0x' || substr(h, 17, 8) AS bigint) % 100 AS shape, cast('0x' || substr(h, 25, 8) AS bigint) % 100 AS turn FROM hashed
), cut AS (
    SELECT doc_id, t, n, least(p, q) AS a, greatest(p, q) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR shape >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
    SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
