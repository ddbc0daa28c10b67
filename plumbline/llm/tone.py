"""Problem 8: abusive, hateful and sexually explicit language in documents.

Every text is folded to bare letters: case, look-alike letters, accents, digits
and signs in place of letters, characters without width, everything that is no
letter, and repeated letters. An Aho-Corasick automaton of the equally folded
lexicon runs over the folded text; every hit is verified against the readable
text (whole words, elongation of three letters or more, letters set apart with
blanks or points) and dropped where it overlaps an exception phrase. Weights of
distinct entries that meet within NEAR bytes add up, and so does what a rule of
the lexicon adds to a hit with the right cues before and behind it: the largest
sum is the peak of a category, a case from THRESHOLD on. The score is the sum of
all weights, rules apart, for each thousand words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .textbytes import pieces, readable

NEAR = 160
THRESHOLD = 1.0
#: Bytes of text before and behind a hit in which its cues are looked for.
AROUND = 72
#: Long texts are scanned in pieces that overlap by so many bytes.
OVERLAP = 512
#: Scores are normalised by no fewer words than this.
LEAST_WORDS = 100
NAMES = tuple(lexicon.CATEGORIES)
SCHEMA = "doc_id long, source string, n_words long, " + ", ".join(f"{n}_peak double, {n}_score double" for n in NAMES)

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    ord(a): b
    for a, b in {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p",
        "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
        "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ß": "ss", "ø": "o", "đ": "d", "ł": "l",
    }.items()
}
# Digits and signs that stand for letters.
STAND_INS = {"o": "0", "i": "1", "l": "1", "e": "3", "a": "4@", "s": "5$", "t": "7", "b": "8", "g": "9"}

_FOLD = np.zeros(256, np.uint8)
for _c in "abcdefghijklmnopqrstuvwxyz":
    for _x in {_c, _c.upper(), *STAND_INS.get(_c, "")}:
        _FOLD[ord(_x)] = ord("i" if _c == "l" else _c)
_LOWER = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], np.uint8)
_LETTER = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


def _slow(raw: bytes) -> bytes:
    text = unicodedata.normalize("NFKD", readable(raw)).lower()
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES)
    return text.encode("ascii", "replace").replace(b"?", b" ")


def folded(phrase: str) -> str:
    out = ""
    for c in phrase.lower():
        f = chr(_FOLD[ord(c)]) if ord(c) < 128 and _FOLD[ord(c)] else ""
        if f and f != out[-1:]:
            out += f
    return out


#: Between letters set apart: a sign or two, a new line with comment marks, or
#: the joint of two string literals.
_APART = r"""(?:[ .\-_~|/]{1,2}|[ "'+\\]{0,4}\r?\n[^a-z0-9\n]{0,8}| ?["'] ?\+\s*["'] ?)"""


def _letters(word: str) -> list[str]:
    """A pattern for each run of equal letters of a word."""
    parts = []
    for m in re.finditer(r"(.)\1*", word):
        c, n = m.group(1), len(m.group())
        kinds = "[" + re.escape(c + STAND_INS.get(c, "")) + "]"
        # A doubled letter may be longer, a single one only from three letters on.
        parts.append(f"{kinds}{{{n},}}" if n > 1 else f"(?:{kinds}{{3,}}|{kinds})")
    return parts


def _word(word: str, least: int = 3) -> str:
    plain = "".join(_letters(word))
    apart = _APART.join(f"[{re.escape(c + STAND_INS.get(c, ''))}]" for c in word)
    return f"(?:{plain}|{apart})" if len(word) >= least else plain


def pattern(phrase: str) -> re.Pattern[bytes]:
    """The readable forms of a lexicon entry, over lower-case bytes."""
    words = [_word(word, 2 if " " in phrase else 3) for word in phrase.split()]
    return re.compile((r"(?<![a-z0-9])" + r"[^a-z0-9]+".join(words) + r"(?![a-z0-9])").encode())


def stem(phrase: str) -> str:
    """The same for the inflections of a word; phrases stay."""
    return phrase if " " in phrase else folded(re.sub(r"(?<=...)(?:ies|ed|ing|ers?|es|s|y|e)$", "", phrase))


#: Between cues: no end of a sentence, no code.
_GAP = r"(?:[^a-z0-9;!?{}()=.]|\.(?!\s)){1,12}"


def cues(text: str, behind: bool) -> re.Pattern[bytes]:
    """What has to end right before a hit or, ``behind`` it, to begin."""
    out = ""
    for token in text.split():
        forms, may = token.removesuffix("?"), token.endswith("?")
        kinds = [r"[a-z0-9@$*']+" if f == "*" else _word(f[:-2], 2) + "(?:" + _word("s", 2) + ")?" if f.endswith("s?") else "[a-z0-9]{2,}" + re.escape(f[1:]) if f[0] == "+" else _word(f, 2) for f in forms.split("|")]
        each = f"(?:{'|'.join(kinds)})(?![a-z0-9])"
        out += f"(?:{_GAP}{each})" if behind else f"(?:(?<![a-z0-9]){each}{_GAP})"
        out += "?" * may
    return re.compile((out if behind else out + r"\Z").encode())


class Lexicon:
    """The automaton with all entries, their patterns, categories and weights."""

    def __init__(self) -> None:
        import ahocorasick

        self.entries: list[tuple[str, int, float]] = []
        self.compiled: dict[int, re.Pattern[bytes]] = {}
        by_fold: dict[str, list[int]] = {}
        listed = [(p, k, w) for k, n in enumerate(NAMES) for p, w in lexicon.CATEGORIES[n].items()] + [(p, -1, 0.0) for p in lexicon.EXCEPTIONS]
        for phrase, kind, weight in listed:
            by_fold.setdefault(folded(phrase), []).append(len(self.entries))
            self.entries.append((phrase, kind, weight))
        #: Rules are entries without a pattern, behind the others; each other entry has the numbers of those about it.
        self.stems: list[int | str] = [f"{k} {stem(p)}" for p, k, _ in listed]
        self.n_plain, self.rules = len(self.entries), [()] * len(self.entries)
        compiled = []
        for category, about, before, behind, weight in lexicon.RULES:
            kind, rule = NAMES.index(category), len(self.entries)
            self.entries.append(("", kind, weight))
            self.stems.append(rule)
            compiled.append((cues(before, False) if before else None, cues(behind, True) if behind else None))
            for e, (phrase, k, _) in enumerate(listed):
                if k == kind and phrase in about:
                    self.rules[e] = (*self.rules[e], rule)
        self.cues = dict(enumerate(compiled, self.n_plain))
        self.automaton = ahocorasick.Automaton()
        for f, which in by_fold.items():
            self.automaton.add_word(f, (len(f), tuple(which)))
        self.automaton.make_automaton()
        # Words of which one letter or two are hidden by asterisks.
        self.masked: dict[bytes, bytes] = {}
        for word in dict.fromkeys(w for p, k, _ in sorted(listed, key=lambda x: (x[1] < 0, len(x[0].split()), -x[2])) for w in p.split() if len(w) > 2):
            for n in (1, 2):
                for hidden in combinations(range(1, len(word) - 1), n):
                    self.masked.setdefault("".join("*" if i in hidden else c for i, c in enumerate(word)).encode(), word.encode())
        # Single words by length and first letter, the weightiest first.
        self.single: dict[tuple[int, int], list[bytes]] = {}
        for phrase, _, weight in sorted(listed, key=lambda x: -x[2]):
            if " " not in phrase and weight >= 0.2 and len(phrase) > 3:
                self.single.setdefault((len(phrase), ord(phrase[0])), []).append(phrase.encode())
        self.joined = {key for key, words in self.single.items() if _JOINED & set(words)}
        self.first = np.isin(np.arange(256), [c for _, c in self.single])

    def pattern(self, e: int) -> re.Pattern[bytes]:
        if e not in self.compiled:  # most entries occur in no text of a task
            self.compiled[e] = pattern(self.entries[e][0])
        return self.compiled[e]

    def applied(self, e: int, text: bytes, lo: int, a: int, b: int, hi: int) -> Iterator[int]:
        """The rules that hold for a hit of an entry at text[a:b] between lo and hi."""
        if self.rules[e]:
            before, behind = text[max(lo, a - AROUND) : a], text[b : min(hi, b + AROUND)]
            for r in self.rules[e]:
                p, q = self.cues[r]
                if (p is None or p.search(before)) and (q is None or q.match(behind)):
                    yield r


@lru_cache(1)
def the_lexicon() -> Lexicon:
    return Lexicon()


def _alnum(window: bytes, i: int) -> bool:
    return 0 <= i < len(window) and bool(_LETTER[window[i]])


def lone_neighbours(window: bytes, a: int, b: int) -> tuple[bool, bool]:
    """Whether letters set apart in [a, b) go on before or behind it, as in
    ``s c u m`` for ``c u m``: a lone letter at the same kind of gap."""

    def lone(gap: int, letter: int, beyond: int, sign: int) -> bool:
        return 0 <= gap < len(window) and window[gap] == sign and _alnum(window, letter) and not _alnum(window, beyond) and window[letter] not in b"ai"

    before = b - a > 2 and not _LETTER[window[a + 1]] and lone(a - 1, a - 2, a - 3, window[a + 1])
    behind = b - a > 2 and not _LETTER[window[b - 2]] and lone(b, b + 1, b + 2, window[b - 2])
    return bool(before), bool(behind)


_TOKEN = re.compile(rb"[a-z0-9]+(?:\*{1,2}[a-z0-9]+)+")


def unmask(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lex: Lexicon) -> np.ndarray:
    """Put the letters back that asterisks inside a lexicon word hide."""
    stars = np.flatnonzero(data == 0x2A)
    stars = stars[(stars > 0) & (stars < len(data) - 1)]
    near = stars[_LETTER[data[stars - 1]]]
    if not len(near):
        return data
    data, done = data.copy(), 0
    for s in near:
        if s < done:
            continue
        t = int(np.searchsorted(ends, s, "right"))
        lo = max(int(starts[t]), int(s) - 24)
        window = data[lo : min(int(ends[t]), int(s) + 48)].tobytes().lower()
        for m in _TOKEN.finditer(window):
            word = lex.masked.get(m.group())
            if word:
                data[lo + m.start() : lo + m.end()] = np.frombuffer(word, np.uint8)
            if m.start() <= s - lo < m.end():
                done = lo + m.end()
                break
    return data


_SIGNS = frozenset(b"*#_.-!|+")
_SIGN = np.isin(np.arange(256), list(_SIGNS))
#: Signs that stand at the end of a word for letters, not for themselves.
_JOINS = np.frombuffer(b"_.-", np.uint8)
_LAST = np.isin(np.arange(256), list(b"*#+"))
#: Signs that look like letters stand for no others.
_LOOKS = {ord("!"): b"il", ord("|"): b"il", ord("+"): b"t"}
#: Words known by their first letter alone.
_BY_ONE = {b"fuck", b"shit", b"cunt", b"bitch"}
#: Words of which signs that join names in code may hide letters.
_JOINED = _BY_ONE | {b"fucking", b"fucker", b"fuckers", b"fucked", b"shitty", b"bullshit", b"asshole", b"assholes", b"motherfucker", b"bastard", b"nigger", b"niggers", b"faggot", b"faggots", b"whore", b"whores", b"slut", b"sluts"}


def hidden_word(token: bytes, lex: Lexicon) -> bytes | None:
    """The entry that a word with hidden letters stands for, by its length and
    the letters that are left."""
    seen = [i for i, c in enumerate(token) if c not in _SIGNS]
    if len(seen) == len(token) or len(token) < 4:
        return None
    joins = any(c in _JOINS for c in token)
    for word in lex.single.get((len(token), token[0]), ()):
        if joins and word not in _JOINED:
            continue
        if (len(seen) > 1 or word in _BY_ONE) and all((_FOLD[c] == _FOLD[w]) if c not in _SIGNS else (w in _LOOKS.get(c, (w,))) for c, w in zip(token, word, strict=True)):
            return word
    return None


def unsign(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lex: Lexicon) -> np.ndarray:
    """Put the letters back for which other signs stand in a word of the
    lexicon: in a run of letters and signs, from its first letter to its last
    letter or hiding sign, of the length and first letter of an entry."""
    lower = _LOWER[data]
    sign, letter = _SIGN[lower], _LETTER[lower]
    if not sign.any():
        return data
    inside = sign | letter
    cut = np.flatnonzero(inside[1:] & inside[:-1]) + 1  # a text may end inside a run
    begin = inside.copy()
    begin[cut] = False
    begin[starts[starts < len(data)]] |= inside[starts[starts < len(data)]]
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(data))
    size = np.add.reduceat(inside.astype(np.int32), at) if len(at) else np.zeros(0, np.int32)
    stop = np.minimum(stop, at + size)
    count = np.concatenate([[0], np.cumsum(sign)])
    few = (size >= 4) & (size <= 24) & (count[stop] > count[at])
    joins = np.concatenate([[0], np.cumsum(np.isin(lower, _JOINS))])
    copied = False
    for a, b in zip(at[few].tolist(), stop[few].tolist(), strict=True):
        while a < b and not lex.first[lower[a]]:
            if letter[a]:
                break
            a += 1
        while b > a and sign[b - 1] and not _LAST[lower[b - 1]]:
            b -= 1
        if (b - a, int(lower[a]) if a < b else 0) not in (lex.joined if joins[b] > joins[a] else lex.single):
            continue
        word = hidden_word(lower[a:b].tobytes(), lex)
        if word and not (lower[b - 1] == 0x2B and b - a > 1 and lower[b - 2] == 0x2B):
            data, copied = data if copied else data.copy(), True
            data[a:b] = np.frombuffer(word, np.uint8)
    return data


def _edges(data: np.ndarray, starts: np.ndarray, kept: np.ndarray, new: np.ndarray) -> tuple[bytes, bytes]:
    """For every run of equal folded letters (``new`` has the place in ``kept``
    of its first) whether a word can begin in it, and whether one can end: at
    its edge or at a gap inside."""
    first, last = kept[new], kept[np.append(new[1:], len(kept)) - 1]
    gap = last - first + 1 > np.diff(np.append(new, len(kept)))
    letter = _LETTER[data]
    fresh = np.zeros(len(data) + 1, bool)  # texts stand side by side
    fresh[starts] = fresh[0] = fresh[-1] = True
    before = fresh[first] | ~letter[first - 1]
    behind = fresh[last + 1] | ~letter[np.minimum(last + 1, len(data) - 1)]
    return (before | gap).tobytes(), (behind | gap).tobytes()


def hits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lex: Lexicon) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with any: ``(from, to, entry)`` of verified hits, relative to its start."""
    data = unsign(unmask(data, starts, ends, lex), starts, ends, lex)
    fold = _FOLD[data]
    inside = starts[starts < len(data)]
    kept = np.flatnonzero(fold)
    if not len(kept):
        return {}
    letters = fold[kept]
    new = np.ones(len(kept), bool)
    new[1:] = letters[1:] != letters[:-1]
    new[np.minimum(np.searchsorted(kept, inside), len(kept) - 1)] = True
    at = kept[new]
    squashed = letters[new].tobytes().decode("ascii")
    begins, stops = _edges(data, inside, kept, np.flatnonzero(new))
    lower, found = None, {}
    for end, (length, which) in lex.automaton.iter(squashed):
        if not (begins[end - length + 1] and stops[end]):
            continue
        first, last = int(at[end - length + 1]), int(at[end])
        t = int(np.searchsorted(ends, first, "right"))
        a, b = int(starts[t]), int(ends[t])
        if last >= b:
            continue
        if lower is None:
            lower = _LOWER[data].tobytes()
        stop = int(at[end + 1]) if end + 1 < len(at) else len(lower)
        # A run of equal letters may begin in the word before or end behind.
        left = max(a, first - 8)
        window = lower[left : min(b, stop + 8)]
        shift = left - a
        for e in which:
            m = lex.pattern(e).search(window, max(a, first - 1) - left)
            if m:
                span, lone = (shift + m.start(), shift + m.end()), lone_neighbours(window, *m.span())
                own = found.setdefault(t, set())
                own.add((*span, e, *lone))
                own.update((*span, r, *lone) for r in lex.applied(e, lower, a, a + span[0], a + span[1], b))
    return {t: _whole(x) for t, x in found.items()}


def _whole(own: set[tuple[int, int, int, bool, bool]]) -> list[tuple[int, int, int]]:
    """Hits that are whole words: where letters set apart go on, the next hit
    must go on as well."""
    begins, stops = {x[0] for x in own}, {x[1] for x in own}
    return sorted((a, b, e) for a, b, e, before, behind in own if not (before and not {a - 1, a - 2} & stops) and not (behind and not {b + 1, b + 2} & begins))


def peaks(own: list[tuple[int, int, int]], lex: Lexicon) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Largest sum within NEAR bytes by category (a word counts once, whatever
    its inflection), and ``(at, kind, weight)`` of
    every hit of an entry that no exception phrase overlaps."""
    but = [(a, b) for a, b, e in own if lex.entries[e][1] < 0]
    left = [(a, e, *lex.entries[e][1:]) for a, b, e in own if lex.entries[e][1] >= 0 and not any(a < y and x < b for x, y in but)]
    best = [0.0] * len(NAMES)
    for i, (a, _, _, _) in enumerate(left):
        seen: dict[int | str, tuple[int, float]] = {}
        for b, e, kind, weight in left[i:]:
            if b - a > NEAR:
                break
            seen[lex.stems[e]] = max((kind, weight), seen.get(lex.stems[e], (kind, 0.0)))
        for k in range(len(NAMES)):
            entries = sum(w for e, (kk, w) in seen.items() if kk == k and isinstance(e, str))
            # Of the rules that hold in one place only the strongest counts.
            best[k] = max(best[k], round(entries + max((w for e, (kk, w) in seen.items() if kk == k and isinstance(e, int)), default=0), 6))
    return best, [(a, kind, weight) for a, e, kind, weight in left if e < lex.n_plain]


def score_batch(batch: pa.RecordBatch, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peaks, sums of weights (rows x categories) and words of each row."""
    n = batch.num_rows
    peak, total, words = np.zeros((n, len(NAMES))), np.zeros((n, len(NAMES))), np.zeros(n, np.int64)
    tail, tail_row = np.zeros(0, np.uint8), -1
    for data, starts, ends, rows in pieces(batch, "text", _slow):
        letter = _LETTER[data]
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        at = np.flatnonzero(begin)
        np.add.at(words, rows, np.searchsorted(at, ends) - np.searchsorted(at, starts))
        over = 0
        if len(rows) == 1:
            if tail_row == rows[0]:
                over = len(tail)
                data = np.concatenate([tail, data])
                starts, ends = np.array([0]), np.array([len(data)])
            tail, tail_row = data[max(0, len(data) - OVERLAP) :], int(rows[0])
        for t, own in hits(data, starts, ends, lex).items():
            best, each = peaks(own, lex)
            r = rows[t]
            peak[r] = np.maximum(peak[r], best)
            ends_of = {a: b for a, b, _ in own}
            for a, kind, weight in each:
                if ends_of[a] > over:  # those before were counted with the piece before
                    total[r, kind] += weight
    return peak, total, words


def tone_scores(documents: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, source, n_words`` and for every
    category ``<name>_peak`` and ``<name>_score`` (weights for each 1,000 words,
    at least LEAST_WORDS of them).

    ``source`` is trimmed lower case, ``unknown`` where null or blank. Null and
    empty texts score zero; repeated rows stay; texts are read whole; extra
    columns are ignored. Nothing is shuffled.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown")).alias("source"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = the_lexicon()
        for batch in batches:
            peak, total, words = score_batch(batch, lex)
            scale = 1000.0 / np.maximum(words, LEAST_WORDS)
            cols = [batch.column(0), batch.column(1), pa.array(words, pa.int64())]
            for k in range(len(NAMES)):
                cols += [pa.array(np.round(peak[:, k], 6)), pa.array(np.round(total[:, k] * scale, 6))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "n_words", *[f"{n}_{x}" for n in NAMES for x in ("peak", "score")]])

    return own.mapInArrow(scan, SCHEMA)


def tone_cases(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, category``: one row for each kind of language found in a document."""
    kinds = F.array(*[F.when(F.col(f"{n}_peak") >= threshold, F.lit(n)) for n in NAMES])
    return scores.select("doc_id", F.explode(F.array_compact(kinds)).alias("category")).distinct()


def tone_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, n_documents`` and for every category its number and share of
    documents and its mean score."""
    aggs = [F.count(F.lit(1)).alias("n_documents")]
    for n in NAMES:
        case = (F.col(f"{n}_peak") >= threshold).cast("long")
        aggs += [F.sum(case).alias(f"n_{n}"), F.round(F.avg(case.cast("double")), 6).alias(f"{n}_rate"), F.round(F.avg(f"{n}_score"), 6).alias(f"mean_{n}_score")]
    return scores.groupBy("source").agg(*aggs)
