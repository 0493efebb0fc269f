"""SentencePiece encoding and decoding by a merge-type prefix table.

A byte-pair encoding of a text is the only sequence of pieces that spells it in which every
piece is the encoding of its own characters and every adjacent pair is the encoding of the two
together. So each prefix of a text has one last piece: of the pieces that end there (matches of
an Aho-Corasick automaton) the one that is compatible with the last piece of the prefix before
it. The table keeps that piece for every prefix; ids are read from its end backwards. The time
is linear in the text, as pieces have a bounded length.

The text is cut where no piece can reach across (before a run of the space mark, and at
characters that occur in no longer piece), and the results for short stretches are kept.

Cases: null counts as empty; empty text has no ids and decodes to empty text; characters
without a piece become byte pieces; a text of one endless word is one stretch; equal rows
give equal rows; an empty table stays empty; other columns do not matter, whatever their names. A model
that changes texts before it encodes them (a normaliser, or white space that it drops) is refused.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from spectraloom.llm.common import map_rows, pick, table

SPACE = "▁"
Entry = tuple[str, tuple[int, ...]]
#: Stretches of at most KEEP_CHARS characters are kept, KEEP of them at most; then keeping starts anew.
KEEP, KEEP_CHARS = 150_000, 32
#: After so many tested pairs their outcomes are forgotten, to bound memory.
TESTS = 600_000


class PrefixTable:
    """Encoder for a sentencepiece BPE model given as its bytes."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        probe = "a  b \u00e9\ufb01\uff21 c"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model changes texts before it encodes them, which the table does not")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.piece = {i: p for p, i in self.ids.items()}
        self.bytes = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        assert all(c in self.ids for p in self.ids for c in p), "a character of a piece is no piece itself"
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        inner = set("".join(p for p in self.ids if len(p) > 1))
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.lines = self.cuts and "\n" not in inner
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "") if self.cuts else r"(?s:.+)").findall
        self.length = [len(sp.id_to_piece(i)) for i in range(n)]
        self.good: list[set[int]] = []
        self.bad: list[set[int]] = []
        self.tested = 0
        self.beside = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.kept: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging of a few characters: the best pair first, the leftmost of equals."""
        symbols, score = list(symbols), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: int, right: int) -> bool:
        """Tests a pair, or with left = -1 a piece alone. Outcomes are kept by left piece."""
        if self.tested % TESTS == 0:
            self.good[:] = [set() for _ in range(len(self.length) + 1)]
            self.bad[:] = [set() for _ in range(len(self.length) + 1)]
        self.tested += 1
        pair = [self.piece[left]] if left >= 0 else []
        pair.append(self.piece[right])
        ok = self.merged("".join(pair)) == pair
        (self.good if ok else self.bad)[left].add(right)
        return ok

    def split(self, text: str) -> list[int]:
        """The ids of one stretch, from its prefix table: ``last[i]`` is the last piece of the first i
        characters, -1 for a character without a piece. Matches come by end, the longest first."""
        last = [-1] * (len(text) + 1)
        good, bad, fits = self.good, self.bad, self.fits
        if not good:
            good += [set()] * (len(self.length) + 1)
            bad += good
        for end, (p, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                left = last[end - n]
                if p in good[left] or (p not in bad[left] and fits(left, p)):
                    last[end] = p
        out, i, length = [], len(text), self.length
        while i:
            p = last[i]
            if p >= 0:
                out.append(p)
                i -= length[p]
            else:
                i -= 1
                out += [self.bytes[f"<0x{b:02X}>"] for b in reversed(text[i].encode())] if self.bytes else [self.unknown]
        out.reverse()
        return out

    def keep(self, key: str, found: Entry) -> Entry:
        if len(key) <= KEEP_CHARS:
            if len(self.kept) >= KEEP:
                self.kept, self.older = {}, self.kept
            self.kept[key] = found
        return found

    def join(self, *parts: Entry) -> Entry:
        return ",".join(p[0] for p in parts), tuple(i for p in parts for i in p[1])

    def entry(self, key: str, text: str) -> Entry:
        """Of one stretch; those met again are kept for as long as KEEP others are met, at least."""
        found = self.kept.get(key) or self.older.get(key)
        if found is None:
            ids = self.split(text)
            found = (",".join(map(str, ids)), tuple(ids))
        return self.keep(key, found)

    def word(self, key: str) -> Entry:
        """A key of ``entries``: a word after a space, or a line end and the word after it. A last
        mark that no piece has after the character before it is a stretch of its own."""
        found = self.older.get(key)
        if found:
            return self.keep(key, found)
        if key[0] == "\n":
            return self.keep(key, self.join(*(self.entry(SPACE + s, s) for s in self.stretches(key))))
        if key[-1] in ".,!?;:" and len(key) > 1 and key[-2:] not in self.beside:
            return self.keep(key, self.join(self.entry(key[:-1], SPACE + key[:-1]), self.entry(SPACE + key[-1], key[-1])))
        return self.entry(key, SPACE + key)

    def entries(self, text: str) -> list[Entry]:
        """Ids of consecutive stretches of a text, as a string and as a list."""
        if not text:
            return []
        if self.lines and SPACE not in text:
            keys = text.replace("\n", " \n").split(" ")
            if "" not in keys:
                out = list(map(self.kept.get, keys))
                if None in out:
                    word = self.word
                    out = [e or self.kept.get(k) or word(k) for e, k in zip(out, keys)]
                    # word() may start a new self.kept; entries found before stay valid
                return out
        return [self.entry(SPACE + s, s) for s in self.stretches(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(e[1] for e in self.entries(text or "")))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def prefix_table(model: bytes) -> PrefixTable:
    return PrefixTable(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids, decoded. The model (some hundred kB) is read on the driver and sent along."""
    model = Path(model_path or default_model()).read_bytes()

    def setup():
        t = prefix_table(model)

        def one(key, value):
            ids = t.encode(value)
            return key, ids, t.decode(ids)

        return one

    return map_rows(pick(docs, doc_id=doc_id, text=text), "doc_id long, ids array<int>, decoded string", setup, 128)


def tokens(docs: DataFrame, model_path: str | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, ids."""
    model = Path(model_path or default_model()).read_bytes()

    def setup():
        t = prefix_table(model)

        def one(key, kind, value):
            ids = t.encode(value)
            return key, kind, len(ids), ids

        return one

    return map_rows(pick(docs, doc_id=doc_id, source=source, text=text), "doc_id long, source string, n_tokens long, ids array<int>", setup, 128)


def digests(docs: DataFrame, model_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``encode`` gives."""
    model = Path(model_path or default_model()).read_bytes()

    def setup():
        t = prefix_table(model)
        sha = hashlib.sha256

        def one(key, value):
            entries = t.entries(value or "")
            ids = list(chain.from_iterable(e[1] for e in entries))
            return key, len(ids), sha(",".join([e[0] for e in entries]).encode()).hexdigest(), sha(t.decode(ids).encode()).hexdigest()

        return one

    return map_rows(pick(docs, doc_id=doc_id, text=text), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", setup, 128)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
