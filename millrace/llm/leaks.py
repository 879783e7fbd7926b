"""Evaluation texts inside a training corpus: template windows, joined by their hash, with slot checks."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import PY_TERM
from millrace.llm.hashing import bit_arrays, bit_size, hash_strings, in_bits
from millrace.plans.store import materialize, small

#: Words of a window.
WINDOW = 13
#: Units of measure, time and money that are units whatever the items say. Fixed values.
UNITS = frozenset(
    """second seconds minute minutes hour hours day days week weeks month months year years decade decades century centuries
    dollar dollars euro euros pound pounds cent cents yen franc francs percent degree degrees
    millimeter millimeters centimeter centimeters cm mm meter meters kilometer kilometers km inch inches foot feet yard yards mile miles
    gram grams g kg kilogram kilograms ton tons ounce ounces oz lb lbs liter liters ml gallon gallons pint pints cup cups spoon spoons
    watt watts volt volts calorie calories joule joules hertz byte bytes""".split()
)
#: Numbers written as words. Fixed values.
NUMBERS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
#: Typed placeholders; the kind of an ordinary word, and of one that no window goes across.
NUMBER, NAME, UNIT, WORD, UNKNOWN = 1, 2, 3, 4, 0
#: Sets of words that tasks hold as bit arrays: names, units learned from the items, all words of the items.
_NAMES, _UNITS, _ALL = 0, 1, 2
#: Bits of one such array, and of the windows' array, at most (64 MB each).
MOST_BITS = 1 << 29
#: Rows of the items' windows that are sent to all tasks at most; more are joined by exchange.
SENT = 200_000
#: Words that a worker keeps at hand.
KEPT_WORDS = 500_000
#: Texts searched at a time.
STEP = 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _is_capital(word: str) -> bool:
    return word[0].isupper() and not word[1:2].isupper()


def _starts_sentence(text: str, at: int) -> bool:
    before = text[:at].rstrip(" \t\"'([")
    return not before or before[-1] in ".!?\n:"


def _plain(text: str) -> str:
    """The text, lower-cased if lower-casing changes where its words end (a dotted capital I becomes two characters)."""
    return text.lower() if "İ" in text else text


def named_words(text: str) -> set[str]:
    """The lower-cased words that a text writes with a capital inside a sentence."""
    return {w.group().lower() for w in re.finditer(PY_TERM, text) if _is_capital(w.group()) and not _starts_sentence(text, w.start())}


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower-cased words of items, whether an item writes the word as a name, and the number that it follows."""
    find = re.compile(PY_TERM)
    for batch in batches:
        rows: set[tuple] = set()
        for text in map(_plain, batch.column(0).to_pylist()):
            names, before = named_words(text), ""
            for w in find.finditer(text):
                k = w.group().lower()
                rows.add((k, k in names, before if before.isdigit() and not k.isdigit() else None))
                before = k
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.string()), strict=True)], names=["word", "named", "after"])


class Lexicon(dict):
    """Numbers of words as written, with hash and kind of each. A word's kind is a function of the word and of the three bit arrays, so a copy of an
    item has the item's kinds, whatever its case: digits and number words are numbers, UNITS and what the items write after
    different numbers are units, what some item writes with a capital inside a sentence is a name. Of the words that no
    item has, those with a capital are names if `fresh` is set; no window goes across the others."""

    def __init__(self, bits: dict[int, np.ndarray], fresh: bool):
        super().__init__()
        self.clear()
        self.bits, self.fresh = bits, fresh
        self.lower: list[str] = [""]
        self.kind = np.zeros(1, np.int8)
        self.code = np.zeros(1, np.uint64)
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        k = self[word] = len(self.lower)
        self.lower.append(word.lower())
        return k

    def settle(self) -> None:
        """Kinds and codes of the words met since the last time."""
        if not self.waiting:
            return
        lower = self.lower[len(self.kind) :]
        h = hash_strings(pa.array(lower, pa.string()))
        number = np.array([w.isdigit() or w in NUMBERS for w in lower])
        known = in_bits(h, self.bits[_ALL])
        unit = np.array([w in UNITS for w in lower]) | in_bits(h, self.bits[_UNITS])
        named = in_bits(h, self.bits[_NAMES])
        if self.fresh:
            named |= ~known & np.array([_is_capital(w) for w in self.waiting])
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(named, NAME, np.where(known, WORD, UNKNOWN))))
        self.kind = np.concatenate([self.kind, kind.astype(np.int8)])
        self.code = np.concatenate([self.code, np.where(kind == WORD, h | np.uint64(8), kind.astype(np.uint64))])
        self.waiting = []


def _hashes(codes: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m codes from each of the places on."""
    out = np.full(len(places), m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(m):
            out = out * _BASE + codes[places + k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


_WINDOW = "m int, h long, words string, kinds string"


def _cut(texts: list[str], lexicon: Lexicon, find) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, a 0 after each text, and the text of each."""
    if len(lexicon) > KEPT_WORDS:
        lexicon.__init__(lexicon.bits, lexicon.fresh)
    flat: list[int] = []
    sizes = []
    for text in texts:
        found = list(map(lexicon.__getitem__, find(_plain(text))))
        flat.extend(found)
        flat.append(0)
        sizes.append(len(found) + 1)
    lexicon.settle()
    return np.array(flat, np.int64), np.repeat(np.arange(len(texts)), sizes)


def _windows(ids: np.ndarray, of: np.ndarray, owners: list[int], lexicon: Lexicon, places: np.ndarray, h: np.ndarray, m: int, owner: str) -> pa.RecordBatch:
    lower, kind = lexicon.lower, lexicon.kind
    at = places.tolist()
    words = [" ".join([lower[i] for i in ids[p : p + m].tolist()]) for p in at]
    kinds = [(kind[ids[p : p + m]] + 48).astype(np.uint8).tobytes().decode() for p in at]
    own = [owners[k] for k in of[places].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.full(len(at), m, np.int32)), pa.array(h.view(np.int64)), pa.array(words, pa.string()), pa.array(kinds, pa.string())], names=[owner, "m", "h", "words", "kinds"])


def _item_windows(shared, window: int):
    """All windows of items: `window` words each, or all the words of an item that has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, lexicon = re.compile(PY_TERM).findall, Lexicon(shared.value, False)
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, of = _cut([text], lexicon, find)
                m = min(window, len(ids) - 1)
                if m:
                    places = np.arange(len(ids) - m)
                    yield _windows(ids, of, [owner], lexicon, places, _hashes(lexicon.code[ids], places, m), m, "item_id")

    return run


def _document_windows(shared, lengths: list[int], fresh: bool):
    """The windows of documents whose hash may be that of an item's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, (bits, met) = re.compile(PY_TERM).findall, shared.value
        lexicon = Lexicon(bits, fresh)
        for batch in batches:
            owners, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(texts), STEP):
                ids, of = _cut(texts[k : k + STEP], lexicon, find)
                codes = lexicon.code[ids]
                blank = np.concatenate(([0], np.cumsum(lexicon.kind[ids] == UNKNOWN)))
                for m in lengths:
                    if len(ids) <= m:
                        continue
                    places = np.flatnonzero(blank[m:] == blank[:-m])
                    h = _hashes(codes, places, m)
                    on = in_bits(h, met)
                    if on.any():
                        yield _windows(ids, of, owners[k : k + STEP], lexicon, places[on], h[on], m, "doc_id")

    return run


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, reworded: bool = False, most_bits: int = MOST_BITS, sent: int = SENT) -> DataFrame:
    """Which items are found in which documents: doc_id, item_id, windows (matching places), changed and kept (slots of the best place).

    Both texts are cut into terms; an item's windows are all runs of `window` terms, or all its terms if it has fewer. Windows
    are canonicalised (numbers, names and units become typed placeholders, see `Lexicon`; names and units are learned from all
    the items), and the documents' windows are joined to the items' by their hash; then the words are compared and the slots
    checked. By default every slot must hold the item's own value (an exact copy, whatever its case and punctuation). With
    reworded=True the slots may hold other values, as long as equal slots of the item hold equal values in the
    document and different ones different values: a question with new names and figures; `changed` tells how many slots
    differ. A new name must be written with a capital.

    Of a corpus only few windows are an item's. Tasks hold the items' words and window hashes as bit arrays (bounded by `most_bits`
    each) and hand on the windows that may match, so the corpus is read once and not exchanged, however many items there
    are; the join drops what only the bits let through. It is a broadcast join up to `sent` windows of items, else one by
    exchange, whose skewed hashes (a passage in very many documents) Spark splits. Whole texts are searched. A bit array
    can take a new name for a word of the items, about once in 60,000 names (more if the items have over 8 million
    words); exact copies are never missed.

    Null and blank texts give no row; items without a term match nothing; a repeated item_id counts as one item with several
    texts; a repeated doc_id as one document; an empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    listed = materialize(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t is not null"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")
    words = listed.select("t").mapInArrow(_item_words, "word string, named boolean, after string")
    words = materialize(words.groupBy("word").agg(F.max("named").alias("named"), (F.countDistinct("after") > 1).alias("unit")))

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hash_strings(b.column(0)).view(np.int64)
            for part, on in ((_NAMES, b.column(1)), (_UNITS, b.column(2)), (_ALL, None)):
                own = h if on is None else h[on.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(own)], names=["part", "h"])

    n = bit_size(words.count(), 64, most_bits)
    bits = bit_arrays(words.mapInArrow(typed, "part int, h long"), dict.fromkeys((_NAMES, _UNITS, _ALL), n))
    own = materialize(listed.mapInArrow(_item_windows(spark.sparkContext.broadcast(bits), window), "item_id long, " + _WINDOW).distinct())
    facts = own.agg(F.count("*").alias("n"), F.collect_set("m").alias("m")).first()
    met = bit_arrays(own.select(F.lit(0).alias("part"), "h"), {0: bit_size(facts["n"], 16, most_bits)})[0]
    shared = spark.sparkContext.broadcast((bits, met))
    near = texts.mapInArrow(_document_windows(shared, sorted(facts["m"]), reworded), "doc_id long, " + _WINDOW)
    if facts["n"] <= sent:
        own = F.broadcast(own)
    d, i = near.alias("d"), own.alias("i")
    both = d.join(i, (F.col("d.m") == F.col("i.m")) & (F.col("d.h") == F.col("i.h")))
    if not reworded:
        found = both.where("d.words = i.words").select("doc_id", "item_id", F.lit(0).alias("changed"), F.lit(0).alias("kept"))
    else:
        both = both.where("d.kinds = i.kinds").select("doc_id", "item_id", F.arrays_zip(F.split("d.words", " ").alias("a"), F.split("i.words", " ").alias("b"), F.split("d.kinds", "").alias("k")).alias("z"))
        both = both.where(F.forall("z", lambda x: (x["k"] < str(WORD)) | (x["a"] == x["b"]))).select("doc_id", "item_id", F.filter("z", lambda x: x["k"] < str(WORD)).alias("z"))
        kinds = lambda *c: F.size(F.array_distinct(F.transform("z", lambda x: F.struct(*(x[k] for k in c)))))
        both = both.where((kinds("a", "b") == kinds("a")) & (kinds("a", "b") == kinds("b")))
        found = both.select("doc_id", "item_id", F.size(F.filter("z", lambda x: x["a"] != x["b"])).alias("changed"), F.size(F.filter("z", lambda x: x["a"] == x["b"])).alias("kept"))
    best = F.min(F.struct("changed", (-F.col("kept")).alias("less")))
    got = found.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), best.alias("b"))
    return got.select("doc_id", "item_id", "windows", F.col("b.changed").cast("long").alias("changed"), (-F.col("b.less")).cast("long").alias("kept"))


def reparameterised(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The items with other figures and names: item_id, text. Every number grows by 11, every name of the text is spelt backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                names = named_words(t)
                other = lambda w, names=names: str(int(w.group()) + 11) if w.group().isdecimal() else w.group()[::-1].capitalize() if w.group().lower() in names else w.group()
                out.append(re.sub(PY_TERM, other, t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["item_id", "text"])

    return items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").mapInArrow(run, "item_id long, text string")
