"""Secret scans: fixed patterns, and guess costs of the values that follow credential words.

Base spans are matches of three patterns over the whole text. The method adds spans of kind
``guess``: every value in a credential context (a word such as password, then ``:``, ``=`` or
``is``) gets the cost of the cheapest way to guess it, by dynamic programming over its
segmentations into common words, dates, repeats, keyboard walks and brute-force spans; values
that cost at least ``10 ** GUESSES`` guesses are spans, and shorter ones that cost nearly as much as
their length can, ``10 ** SHARE`` a character. A value of letters alone is as a rule a word of the
sentence, so it must cost as much with the words of a language too: some ten thousands with their
ranks, from the vocabularies of public tokenizers (``dictionary``), of which the paths are parameters.
Punctuation at the end of a value does not count. All segment lengths are bounded but for
brute force and repeats, which extend from character to character, so the time is linear.

Cases: null counts as empty; empty text has no spans; positions count code points; equal spans
of one kind occur once; spans of different kinds may overlap; rows that repeat are scanned each; an
empty table stays empty; very long texts and values are scanned whole; columns are found by place, so
others whose names differ in case only do no harm. Where the vocabularies are not installed a scan fails;
one that is asked for without any (``vocabularies=()``) takes rarer words that follow "is" for secrets.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import lru_cache
from math import log10
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from spectraloom.llm.common import map_rows, pick, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(r"""(?ia)(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credentials?|auth[_-]?key)s?["']?[\x20\t]*(?:=>|[:=]|is\b)[\x20\t]*["']?([^\s"'<>]{6,})""")
HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth")
GUESSES, SHARE = 10.0, 0.8

#: Common passwords and words, the most common first.
WORDS = (
    "password 123456 12345678 qwerty abc123 letmein monkey dragon iloveyou admin welcome login princess sunshine "
    "master shadow football baseball superman trustno1 hello freedom whatever michael jordan secret summer winter "
    "spring autumn love test user root guest default changeme example sample demo pass word access server system "
    "public private token value string null none true false undefined your here key api name date time home work "
    "the and for you this that with from have are was not but all can will one out get has him her his how man new "
    "now old see two way who boy did its let put say she too use dog cat red blue green black white orange apple"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
#: Letters of the longest word that is looked up, and of the shortest.
LONGEST, SHORTEST = 20, 3
#: Vocabularies that words are taken from, by name among the installed tokenizers.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "word_bpe_49k.json")
END = "().,;:!?"
LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
DATES = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
SEGMENT, BRUTE, PERIOD = log10(2), 1.0, 8


def _neighbours() -> dict[str, dict[str, int]]:
    """For each key the keys beside it, with the direction."""
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
    steps = {(0, -1): 0, (0, 1): 1, (-1, 0): 2, (-1, 1): 3, (1, 0): 4, (1, -1): 5}
    back = {v: k for k, v in at.items()}
    return {c: {back[(r + dr, k + dk)]: d for (dr, dk), d in steps.items() if (r + dr, k + dk) in back} for c, (r, k) in at.items()}


BESIDE = _neighbours()
DEGREE = sum(map(len, BESIDE.values())) / len(BESIDE)


def words_of(path: str) -> list[str]:
    """The whole words of a vocabulary in its order: tokens of letters that begin with a space (in files of
    ranks) or that end a word (in JSON)."""
    raw = Path(path).read_bytes()
    if path.endswith(".json"):
        vocab = json.loads(raw)["model"]["vocab"]
        found = (t[:-4] for t in sorted(vocab, key=vocab.get) if t.endswith("</w>"))
    else:
        ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, raw.splitlines()))
        found = (t[1:].decode("utf-8", "ignore") for _, t in ranks if t[:1] == b" ")
    return [w.lower() for w in found if w.isalpha() and SHORTEST <= len(w) <= LONGEST]


def default_vocabularies() -> tuple[str, ...]:
    """The paths of VOCABULARIES. Where they are not installed that is an error: a scan without them gives other
    spans. ``vocabularies=()`` asks for one."""
    import public_tokenizers

    return tuple(str(public_tokenizers.path(name)) for name in VOCABULARIES)


@lru_cache(maxsize=4)
def dictionary(paths: tuple[str, ...] | None = None) -> dict[str, int]:
    """Rank of each word: the best of any of the vocabularies, and of the common passwords."""
    out = dict(RANK)
    for path in default_vocabularies() if paths is None else paths:
        for rank, word in enumerate(dict.fromkeys(words_of(path)), 1):
            out[word] = min(out.get(word, rank), rank)
    return out


def _candidates(value: str, ranks: dict[str, int] = RANK) -> dict[int, list[tuple[int, float]]]:
    """Matches by end: (start, log10 of guesses) of words, dates and keyboard walks."""
    low = value.lower() if len(value.lower()) == len(value) else value
    plain = low.translate(LEET)
    out: dict[int, list[tuple[int, float]]] = {}
    for i in range(len(low)):
        for j in range(i + SHORTEST, min(len(low), i + LONGEST) + 1):
            rank = ranks.get(low[i:j])
            cost = log10(rank) if rank else None
            if cost is None and (rank := ranks.get(plain[i:j])):
                cost = log10(rank) + log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j]))
            if cost is not None:
                upper = sum(c.isupper() for c in value[i:j])
                out.setdefault(j, []).append((i, cost + (log10(2) * min(upper, j - i - upper + 1) if upper else 0)))
    for m in DATES.finditer(value):
        years = 100 if len(m[0]) == 4 else 100 * 365
        out.setdefault(m.end(), []).append((m.start(), log10(years) + (log10(4) if re.search(r"[-/.]", m[0]) else 0)))
    start, way, turns = 0, None, 0
    for i in range(1, len(low) + 1):
        step = BESIDE.get(low[i - 1], {}).get(low[i]) if i < len(low) else None
        if step is None:
            if i - start >= 4:
                out.setdefault(i, []).append((start, log10(len(BESIDE) * (i - start)) + turns * log10(DEGREE)))
            start, way, turns = i, None, 0
        elif step != way:
            way, turns = step, turns + 1
    return out


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation needs, with words by their ranks."""
    n, ends = len(value), _candidates(value, ranks)
    best, brute = [0.0] + [float("inf")] * n, [float("inf")] * (n + 1)
    runs = [0] * (PERIOD + 1)
    for i in range(1, n + 1):
        brute[i] = min(brute[i - 1], best[i - 1] + SEGMENT) + BRUTE
        best[i] = brute[i]
        for start, cost in ends.get(i, ()):
            best[i] = min(best[i], best[start] + SEGMENT + cost)
        for p in range(1, PERIOD + 1):
            runs[p] = runs[p] + 1 if i > p and value[i - 1] == value[i - 1 - p] else 0
            times = runs[p] // p + 1
            if times >= 2 and (p > 1 or times >= 3):
                best[i] = min(best[i], best[i - times * p] + SEGMENT + p * BRUTE + log10(times))
    return best[n]


def chosen(value: str, least: float, words: dict[str, int]) -> bool:
    """Whether a value in a credential context is a secret."""
    core = value.rstrip(END)
    if len(core) < SHORTEST:
        return False

    def dear(ranks):
        cost = guess_cost(core, ranks)
        return cost >= least or cost >= SHARE * len(core)

    return dear(RANK) and (not LETTERS.fullmatch(core) or dear(words))


def scan(text: str | None, least: float = GUESSES, words: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in order."""
    if not text:
        return []
    found, words = [], dictionary() if words is None else words
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if chosen(m[1], least, words)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def redact(text: str | None, mark: str = "[SECRET]", words: dict[str, int] | None = None) -> str | None:
    """The text with every stretch of overlapping spans replaced by the mark."""
    spans = scan(text, words=words)
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k][0], spans[k][2]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], mark]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", vocabularies: tuple[str, ...] | None = None) -> DataFrame:
    """docs with the text redacted, and n_chars (if it is a column) set to the new length."""
    names, at = docs.columns, docs.columns.index(text)
    words = docs.sparkSession.sparkContext.broadcast(dictionary(vocabularies))

    def setup():
        count = names.index(n_chars) if n_chars in names else None

        def one(*row):
            row = list(row)
            old, row[at] = row[at], redact(row[at], words=words.value)
            if count is not None and row[at] is not old and row[at] != old:
                row[count] = len(row[at])
            return tuple(row)

        return one

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return map_rows(plain, kinds, setup).toDF(*names)


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = GUESSES, vocabularies: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_guess."""
    words = docs.sparkSession.sparkContext.broadcast(dictionary(vocabularies))

    def setup():
        def one(key, value):
            found = scan(value, least, words.value)
            n = [sum(k == kind for _, k, _ in found) for kind in range(4)]
            tell = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in found]
            base = ",".join(x for k, x in tell if k < 3)
            return key, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in tell), n[3]

        return one

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return map_rows(pick(docs, doc_id=doc_id, text=text), ddl, setup)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
