"""Encoding texts with public tokenizers: token ids of batches, and token counts with overlap resynchronisation."""

from __future__ import annotations

import contextlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import bounded, held



def load(path: str):
    """The tokenizer of a .json file, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Letters that neither lower-casing nor composition changes.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = f"^[{_LETTERS}]+$"
#: Such a letter and a sign of ASCII but the apostrophe: a pre-token ends between them, whatever comes before and after.
_LETTER_SIGN = rf"([{_LETTERS}])([!-&(-/:-@\[-`{{-~])"
#: Normalisers that change nothing in such letters with single spaces between words.
_IDLE = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a file with the words it has met; a Python worker's tasks share it."""
    return held(("words", path), lambda: WordEncoder(path))


class WordEncoder:
    """Ids of whole texts from a tokenizer whose normaliser and pre-tokenizer never look across white space.

    That holds where the pre-tokenizer drops white space and nothing else joins words, as in word_bpe_49k.json; then a
    text's ids are those of its white-space-separated words one after the other, and each distinct word need be encoded
    once. The words met are kept, up to `most` of them; then those are forgotten that didn't come again since the last time.
    They are found by their hashes, kept in order, and compared whole, so that a lookup costs as many steps as there are
    words to look up, not as there are words known.
    """

    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer, self.most = load(path), most
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        suffix, first = said["model"].get("end_of_word_suffix"), said.get("normalizer") or {}
        self.idle = bool(first) and all(x in _IDLE for x in first.get("normalizers", [first]))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.end_of_word = None
        if suffix:
            self.end_of_word = np.zeros(1 + max(vocabulary.values()), bool)
            self.end_of_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words = pa.array([], pa.large_string())
        self.lengths, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)  # words that came again since words were forgotten
        self.hashes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ascending hashes, the words' places

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        return np.fromiter(map(hash, words.to_numpy(zero_copy_only=False)), np.int64, len(words))

    def _find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The places of words, -1 for unknown ones. Of words with equal hashes one is found, the others count as unknown."""
        places = np.full(len(words), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            like = np.flatnonzero(self.hashes[at] == hashes)
            found = self.places[at[like]]
            same = pc.equal(words.take(pa.array(like)), self.words.take(pa.array(found))).to_numpy(zero_copy_only=False).astype(bool)
            places[like[same]] = found[same]
        return places

    def _keep(self, known: np.ndarray, room: int) -> np.ndarray:
        """Forgets all words but those that came again, or if these are more than room, all but those at the places `known`
        (-1: none). Returns the new places of the latter."""
        stays = self.again.copy()
        if stays.sum() > room:
            stays[:] = False
            stays[known[known >= 0]] = True
        old, new = np.flatnonzero(stays), np.cumsum(stays) - 1
        n, first = self.lengths[old], self.starts[old]
        ends = np.cumsum(n)
        self.ids = self.ids[np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))]
        self.lengths, self.starts = n, ends - n
        self.words, self.again = self.words.take(pa.array(old)), np.zeros(len(old), bool)
        kept = stays[self.places]
        self.hashes, self.places = self.hashes[kept], new[self.places[kept]]
        return np.where(known >= 0, new[known], -1) if len(stays) else known

    @contextlib.contextmanager
    def _bare(self):
        """What runs within it encodes without the normaliser, if that is idle on plain words: it takes a third of their time."""
        from tokenizers import normalizers

        whole = self.tokenizer.normalizer
        if self.idle:
            self.tokenizer.normalizer = normalizers.Sequence([])
        try:
            yield
        finally:
            self.tokenizer.normalizer = whole

    def _ids(self, texts: list[str], at_once: int) -> list[list[int]]:
        """Ids of each text; what the library gives beside them is let go after every `at_once`."""
        return [x.ids for lo in range(0, len(texts), at_once) for x in self.tokenizer.encode_batch_fast(texts[lo : lo + at_once], add_special_tokens=False)]

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Encodes and keeps new words; their places."""
        plain = np.zeros(len(words), bool)
        if self.end_of_word is not None:
            plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(~plain, kind="stable")
        words = words.take(pa.array(order))
        n_plain, parts, lengths = int(plain.sum()), [], []
        if n_plain:  # one pre-token each, and only its last id ends a word: encoded side by side, cut after these ids
            lines = [" ".join(words.slice(lo, min(256, n_plain - lo)).to_pylist()) for lo in range(0, n_plain, 256)]
            with self._bare():
                ids = np.concatenate([np.array(x, np.uint32) for x in self._ids(lines, 8)])
            ends = np.flatnonzero(self.end_of_word[ids])
            parts.append(ids)
            lengths.append(np.diff(ends, prepend=-1))
            if len(ends) != n_plain:
                raise ValueError("a word of letters wasn't one pre-token")
        if n_plain < len(words):
            found = self._ids(words.slice(n_plain).to_pylist(), 1024)
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        n, place = np.concatenate(lengths), np.empty(len(words), np.int64)
        place[order] = len(self.words) + np.arange(len(words))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.ids = np.concatenate([self.ids, *parts])
        self.words = pa.concat_arrays([self.words, words])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])
        hashes, places = np.concatenate([self.hashes, hashes]), np.concatenate([self.places, place])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]
        return place

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The uint32 ids of each text; none for null."""
        words = self._words(texts)
        each = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        del words
        hashes = self._hashes(coded.dictionary)
        known = self._find(coded.dictionary, hashes)
        self.again[known[known >= 0]] = True
        new = np.flatnonzero(known < 0)
        if len(self.words) + len(new) > self.most:
            known = self._keep(known, self.most // 2)
        if len(new):
            known[new] = self._learn(coded.dictionary.take(pa.array(new)), hashes[new])
        k = known[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.lengths[k]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[k] - (ends - n), n) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])]
        return [ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    @staticmethod
    def _words(texts: list[str | None] | pa.Array) -> pa.Array:
        """Lists of words that the pre-tokenizer treats apart: runs of what isn't U+0009 to U+000D or space. To meet fewer
        distinct ones, A-Z are lower-cased, as the normaliser does, and a sign after a letter is set apart, as the
        pre-tokenizer does; not in texts that may hold special strings, which are matched before that, and not in texts
        with combining marks, since the normaliser composes first and some letters compose in lower case only."""
        if isinstance(texts, pa.Array):  # a slice is copied first: kernels down the line take its whole buffer for its own
            texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        raw = pc.fill_null(pa.array(texts, pa.large_string()), "")
        plain = pc.replace_substring_regex(pc.ascii_lower(raw), _LETTER_SIGN, r"\1 \2")
        return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(raw, r"<\||\p{M}"), raw, plain))


# -- counts ------------------------------------------------------------------------------------------------------------


#: White space of Unicode, and the separators U+001C to U+001F.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts in which some white space isn't one space or line feed between two other characters.
_ODD = f"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$|[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]"


class UnitCounter:
    """Token counts of ordinary texts by counts of their units, each of which is encoded once.

    In the byte-level splitting pattern a pre-token is a contraction, letters, digits or other signs with at most one
    space before them, or white space. So where a single space stands between two characters that aren't white space, a
    pre-token begins with it; a single line feed there is one by itself; and a full stop or comma between a letter and
    white space (or the end) is one too. These places are proven stable: units between them can be counted apart.
    """

    def __init__(self, tokenizer, most: int = 300_000):
        self.tokenizer, self.most, self.known = tokenizer, most, {}
        self.line_feed = len(tokenizer.encode("\n", add_special_tokens=False).ids)

    def count(self, texts: pa.Array) -> np.ndarray:
        """texts: without white space other than single spaces and line feeds inside."""
        feeds = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False)
        lines = pc.replace_substring(texts, " ", "\n ")
        lines = pc.replace_substring_regex(lines, r"([A-Za-z])([,.])(\n|$)", "\\1\n\\2\\3")
        units = pc.split_pattern(lines, "\n")
        each = pc.list_value_length(units).to_numpy(zero_copy_only=False)
        coded = units.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        n = np.fromiter((self.known.get(u, -1) for u in distinct), np.int64, len(distinct))
        new = np.flatnonzero(n < 0)
        if len(new):
            n[new] = np.fromiter(map(len, self.tokenizer.encode_batch_fast([distinct[i] for i in new], add_special_tokens=False)), np.int64, len(new))
            if len(self.known) + len(new) > self.most:  # keep those that came again just now
                self.known = {u: self.known[u] for u in distinct if u in self.known}
            self.known.update(zip([distinct[i] for i in new], n[new].tolist()))
        total = np.concatenate([[0], np.cumsum(n[coded.indices.to_numpy(zero_copy_only=False)])])
        ends = np.cumsum(each)
        return total[ends] - total[ends - each] + feeds * self.line_feed


class ResyncCounter:
    """Token counts of whole texts; huge ones are encoded in overlapping chunks and spliced.

    A chunk is a slice of the text, encoded with offsets. Two neighbouring chunks are spliced at a place p that is proven
    stable: in both, a pre-token begins at p, and in the left one at least `spare` further pre-tokens follow before its
    end. Left of p the left chunk is right, since its splitting reads forwards and has seen beyond p; from p on the right
    chunk is right, since splitting that stands at p depends on what follows only. A special string that the left chunk's
    end cuts lies within the spare; one that the right chunk's start cuts lies before p, as the left chunk has it whole.
    Without such a place, the overlap is widened: the right chunk begins earlier, by twice the overlap, until it reaches
    the left chunk's first place, where both are one: then the left chunk is encoded again with a later end.
    """

    def __init__(self, path: str, chunk: int = 16_384, overlap: int = 256, spare: int = 8):
        self.tokenizer, self.chunk, self.overlap, self.spare = load(path), chunk, overlap, spare
        self.units = UnitCounter(self.tokenizer)

    def _starts(self, encoding, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text where pre-tokens begin, ascending, and the number of tokens before each."""
        words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = np.array([o[0] for o in encoding.offsets], np.int64)
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (words[1:] < 0)]))
        return begins[first] + base, first

    def _encode(self, text: str, lo: int, hi: int):
        e = self.tokenizer.encode(text[lo:hi], add_special_tokens=False)
        places, before = self._starts(e, lo)
        return places, before, len(e.ids)

    def count_huge(self, text: str) -> int:
        n, total = len(text), 0
        lo, size = 0, self.chunk  # everything before lo is counted; a pre-token of the whole text begins at lo
        places, before, tokens = self._encode(text, lo, min(n, lo + size))
        known = 0  # tokens of the left chunk before lo
        hi = min(n, lo + size)
        while hi < n:
            overlap, spliced = self.overlap, False
            usable = places[: max(0, len(places) - self.spare)]
            while True:
                start = max(lo, hi - overlap)
                if start <= lo:
                    break
                end = min(n, start + self.chunk)
                r_places, r_before, r_tokens = self._encode(text, start, end)
                common = np.intersect1d(usable[usable > start], r_places)  # start itself is where the slice was cut
                common = common[common > lo]
                if len(common):
                    p = int(common[-1])
                    total += int(before[np.searchsorted(places, p)]) - known
                    known = int(r_before[np.searchsorted(r_places, p)])
                    lo, hi, places, before, tokens, spliced = p, end, r_places, r_before, r_tokens, True
                    size = self.chunk
                    break
                overlap *= 2
            if not spliced:  # one pre-token, or too few, up to hi: a longer left chunk
                size *= 2
                hi = min(n, lo + size)
                places, before, tokens = self._encode(text, lo, hi)
                known = 0
        return total + tokens - known

    def count_all(self, texts: list[str]) -> list[int]:
        """Huge texts are spliced, others counted by units, or as one where their white space is odd."""
        out = np.zeros(len(texts), np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        for i in np.flatnonzero(size > 2 * self.chunk):
            out[i] = self.count_huge(texts[i])
        small = np.flatnonzero(size <= 2 * self.chunk)
        column = pa.array([texts[i] for i in small], pa.large_string())
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False).astype(bool)
        out[small[~odd]] = self.units.count(column.filter(pa.array(~odd)))
        whole = self.tokenizer.encode_batch_fast([texts[i] for i in small[odd]], add_special_tokens=False)
        out[small[odd]] = [len(e.ids) for e in whole]
        return out.tolist()


def resync_counter(*key) -> ResyncCounter:
    """A counter with the units it has met; a Python worker's tasks share it."""
    return held(("counts", *key), lambda: ResyncCounter(*key))


def _slices(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str]]:
    """The texts (null: empty) in lists of about most characters."""
    part, size = [], 0
    for x in texts:
        part.append(x or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_count(path: str, chunk: int = 16_384, overlap: int = 256):
    """A column function text -> number of tokens of the whole text; null counts as empty: 0."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = resync_counter(path, chunk, overlap)
        for texts in batches:
            yield pa.array([n for part in _slices(texts.to_pylist()) for n in counter.count_all(part)], pa.int64())

    return count


def token_count_query(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    d = bounded(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(path)(F.col("text")).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


