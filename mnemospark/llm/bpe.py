"""BPE encoding and decoding with forced cuts inside words.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be joined by a merge, so a word may be cut there, its fragments encoded on their
own and their ids put in a row. A worker keeps the ids of words it has met.

The vocabulary file is one of the ``tokenizers`` library with: NFC, white space
to one blank, lower case; words by pattern; byte symbols; a mark at word ends.
The library's own normalizer and splitter handle any text with a character
beyond Latin Extended-A; below that their rules are plain and applied here.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemospark.llm.common import map_batches, texts, worker_state

#: Words a worker keeps in each of two generations; bounds memory only.
KEPT_WORDS = 200_000

#: Symbols from which a fragment is joined with a heap; the result is the same.
LONG = 64

NEVER = 1 << 30

#: Characters up to here have no composed forms to change and fixed classes.
PLAIN_END = 0x180


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in shown}
    for b in range(256):
        symbols.setdefault(b, chr(0x100 + len(symbols) - len(shown)))
    return [symbols[b] for b in range(256)]


def _patterns(contractions: str) -> tuple[re.Pattern, re.Pattern]:
    """The word pattern with its classes spelled out: for ASCII, and below PLAIN_END.

    Letters come first: no alternative begins with a character of another, but
    for the last two.
    """

    def build(end: int) -> re.Pattern:
        of = lambda start: "".join(re.escape(chr(c)) for c in range(end) if unicodedata.category(chr(c))[0] == start)
        letters, numbers, blank = of("L"), of("N"), "\t\n\x0b\x0c\r \x85\xa0"
        return re.compile(f"[{letters}]+|[{numbers}]|{contractions}|[^{blank}{letters}{numbers}]+")

    return build(0x80), build(PLAIN_END)


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = file.read()
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        byte_of = {c: b for b, c in enumerate(self.symbols)}
        self.byte_of = byte_of
        #: Which byte pairs occur inside a token; all others are certain cuts.
        self.joined = np.zeros((256, 256), bool)
        for token in self.vocabulary:
            body = [byte_of[c] for c in token.removesuffix(self.suffix)]
            self.joined[body[:-1], body[1:]] = True
        ids = self.vocabulary
        #: Id of each byte, and of each byte at a word's end.
        self.first_ids = np.array([ids[c] for c in self.symbols] + [ids[c + self.suffix] for c in self.symbols], np.int64)
        pairs = sorted((ids[a] << 20 | ids[b], rank) for (a, b), rank in self.ranks.items())
        self.pair_keys, self.pair_ranks = (np.array(c, np.int64) for c in zip(*pairs))
        #: The id that the rule of each rank makes.
        self.made = np.array([ids[a + b] for a, b in self.ranks], np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ascii_pattern, self.pattern = _patterns(pattern.partition(r"|[\p{L}]")[0])
        self.not_plain = re.compile(f"[^\x00-{chr(PLAIN_END - 1)}]")
        names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.specials.items()}
        self.token_bytes = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self._content, self._library = content, None
        #: Ids of words met lately, and of those met before them.
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.fixed = {t: i.to_bytes(4, "little") for t, i in self.specials.items()}

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._content)
        return self._library

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NEVER where no rule joins them."""
        keys = left << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers; all words at once.

        All fragments of all words lie in one array. Each round joins in every
        fragment its pair of lowest rank, leftmost first, and sets aside the
        fragments that no rule joins any more.
        """
        if not words:
            return []
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(w) for w in raw])
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        symbols = self.first_ids[flat + 256 * last.astype(np.int64)]
        cut = last.copy()
        cut[:-1] |= ~self.joined[flat[:-1], flat[1:]]
        places = np.arange(len(flat))
        out, kept = symbols.copy(), np.ones(len(flat), bool)

        starts = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1])
        sizes = np.diff(np.concatenate([starts, [len(flat)]]))
        for k in np.flatnonzero(sizes > LONG):
            a, n = starts[k], sizes[k]
            joined = self._joined_long(symbols[a : a + n].tolist())
            out[a : a + len(joined)], kept[a + len(joined) : a + n] = joined, False
        live = np.repeat((sizes > 1) & (sizes <= LONG), sizes)
        symbols, cut, places = symbols[live], cut[live], places[live]
        ranks = np.full(len(symbols), NEVER)
        inner = np.flatnonzero(~cut)
        ranks[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1])
            low = np.minimum.reduceat(ranks * len(ranks) + np.arange(len(ranks)), starts)
            going = low < NEVER * len(ranks)
            at = low[going] % len(ranks)
            out[places[at]] = symbols[at] = self.made[ranks[at]]
            cut[at] = cut[at + 1]
            kept[places[at + 1]] = False
            # Out go the right halves of joined pairs, and fragments that are done.
            stay = np.repeat(going, np.diff(np.concatenate([starts, [len(symbols)]])))
            stay[at + 1] = False
            at = np.cumsum(stay)[at] - 1
            symbols, cut, places, ranks = symbols[stay], cut[stay], places[stay], ranks[stay]
            ranks[at] = NEVER
            for inner in (at[~cut[at]], (before := at[at > 0] - 1)[~cut[before]]):
                ranks[inner] = self._rank(symbols[inner], symbols[inner + 1])
        upto = np.concatenate([[0], np.cumsum(kept)[ends - 1]]) * 4
        ids = out[kept].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(upto.tolist(), upto[1:].tolist())]

    def _joined_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links: n log n for fragments without end."""
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(k: int) -> None:
            a, b = parts[k], parts[right[k]]
            at = bisect_left(self.pair_keys, a << 20 | b)
            if at < len(self.pair_keys) and self.pair_keys[at] == a << 20 | b:
                rank = int(self.pair_ranks[at])
                heapq.heappush(heap, (rank, k, a, b, int(self.made[rank])))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, at, a, b, both = heapq.heappop(heap)
            nxt = right[at]
            if nxt < 0 or parts[at] != a or parts[nxt] != b:
                continue
            parts[at], parts[nxt] = both, -1
            right[at] = right[nxt]
            if right[nxt] >= 0:
                left[right[nxt]] = at
            for k in (left[at], at):
                if k >= 0 and right[k] >= 0:
                    offer(k)
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        """Words of a text in order; a special string counts as a word of its own."""
        if "<|" not in text and not self.not_plain.search(text):
            return (self.ascii_pattern if text.isascii() else self.pattern).findall(text.lower())
        out: list[str] = []
        for stretch in self.special_split.split(text) if self.special_split else [text]:
            if stretch in self.specials:
                out.append(stretch)
            elif stretch and not self.not_plain.search(stretch):
                out += self.pattern.findall(stretch.lower())
            elif stretch:
                normal = self.library.normalizer.normalize_str(stretch)
                found = self.library.pre_tokenizer.pre_tokenize_str(normal)
                out += [bytes([self.byte_of[c] for c in w]).decode() for w, _ in found]
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids by word, for these words and whatever else is kept."""
        if len(self.kept) > KEPT_WORDS:
            self.before, self.kept = self.kept, {}
        new = list(words.difference(self.kept))
        known = {w: ids for w in new if (ids := self.before.get(w)) is not None}
        self.kept.update(known)
        if len(known) < len(new):
            new = [w for w in new if w not in known]
            self.kept.update(zip(new, self.encode_words(new)))
        self.kept.update(self.fixed)
        return self.kept

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers."""
        split = [self.words(t) for t in texts]
        ids = self.learn(set().union(*split))
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: without a decoder in the file, tokens with blanks between.

        Ids that no token has are left out.
        """
        names, known = self.token_bytes, len(self.token_bytes)
        numbers = array("I", ids) if array("I").itemsize == 4 else np.frombuffer(ids, "<u4").tolist()
        return b" ".join([names[i] for i in numbers if i < known and names[i]])


def load(path: str) -> WordBpe:
    """The encoder of a vocabulary file, kept from batch to batch."""
    return worker_state(("bpe", path), lambda: WordBpe(path))


def as_text(column: pa.Array) -> list[str]:
    """Texts of a binary column; null is empty."""
    return [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every whole text.

    A map: one row out for each row in, also for repeated rows; a null text is
    taken as empty and gives no ids, a null doc_id stays.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict:
        bpe = load(path)
        return {"doc_id": batch["doc_id"], "ids": bpe.encode_batch(as_text(batch["text"]))}

    return map_batches(texts(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the ids stand for; null ids give empty text."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict:
        bpe = load(path)
        found = batch["ids"].to_pylist()
        return {"doc_id": batch["doc_id"], "ids": batch["ids"], "decoded": [bpe.decode(i or b"").decode() for i in found]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded string")
