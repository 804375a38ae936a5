"""Texts of exchanges, and the analysis of texts and queries into terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EMBEDDED, SNIPPET, TOKEN_BYTES, TRANSCRIPT

#: White space in patterns: also the no-break space, the ideographic space and the byte order mark.
BLANK = r"[\s 　﻿]"
#: Scripts written without spaces between words.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
#: A run of letters and digits of one kind: of a script without spaces, or of any other.
RUN = rf"[{CJK}&&[\p{{L}}\p{{N}}]]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"
#: The same in texts without such scripts.
PLAIN_RUN = r"[\p{L}\p{N}]+"


def document_text(user: Column, assistant: Column) -> Column:
    """What text search sees: both sides, whole."""
    return F.concat(user, F.lit("\n\n"), assistant)


def embedded_text(user: Column, assistant: Column) -> Column:
    """What the embedder sees: both sides with their roles, the first 2000 characters."""
    return F.substring(F.concat(F.lit("User: "), user, F.lit("\n\nAssistant: "), assistant), 1, EMBEDDED)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(rf"^{BLANK}*$")


def snippet(user: Column, assistant: Column) -> Column:
    """The opening of the user's side (of the assistant's where that is blank), on one line."""
    source = F.when(is_blank(user), assistant).otherwise(user)
    opening = trimmed(F.regexp_replace(F.substring(source, 1, SNIPPET), f"{BLANK}+", " "))
    return F.concat(opening, F.when(F.length(source) > SNIPPET, F.lit("...")).otherwise(F.lit("")))


def transcript_text(turns: Column, most: int = TRANSCRIPT) -> Column:
    """One text of ordered (user, assistant) structs; the middle goes where it is too long."""
    full = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("User: "), t["user"], F.lit("\nAssistant: "), t["assistant"])), "\n\n")
    half = most // 2
    return F.when(F.length(full) <= most, full).otherwise(F.concat(F.substring(full, 1, half), F.lit("\n[…]\n"), F.right(full, F.lit(half))))


def extract_summary(reply: Column) -> Column:
    """The text in the first summary element, null where there is none or it is empty."""
    return F.nullif(trimmed(F.regexp_extract(reply, r"(?is)<summary>(.*?)</summary>", 1)), F.lit(""))


def raw_terms(text: Column) -> Column:
    """Lower-case terms in order: words of fewer than 40 bytes, and for scripts without spaces each pair of neighbours."""
    runs = lambda pattern: F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))

    def split(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))
        return F.when(run.rlike(f"^[{CJK}]") & (F.length(run) > 1), pairs).otherwise(F.array(run))

    # Few texts have such a script, and only theirs are looked at run by run.
    words = F.when(text.rlike(f"[{CJK}]"), F.flatten(F.transform(runs(RUN), split))).otherwise(runs(PLAIN_RUN))
    return F.filter(words, lambda t: F.octet_length(t) < TOKEN_BYTES)


def with_terms(rows: DataFrame, text: Column, stemmed: bool = True) -> DataFrame:
    """id and terms of each row; stems are made in Arrow batches, one look-up for each distinct term of a batch."""
    raw = rows.select("id", raw_terms(text).alias("terms"))
    if not stemmed:
        return raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            words = lists.flatten().dictionary_encode()
            stems = pa.array([stem(t) for t in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            offsets = pc.subtract(lists.offsets, lists.offsets[0]) if len(lists) else lists.offsets
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, stems, mask=lists.is_null() if lists.null_count else None)], ["id", "terms"])

    return raw.mapInArrow(run, "id long, terms array<string>")


def _is_cjk(c: str) -> bool:
    o = ord(c)
    return 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x2FA1F


def query_terms(text: str, stemmed: bool = True) -> list[str]:
    """The terms of a query text, as ``terms`` has them; on the driver, for one short text."""
    import unicodedata

    out: list[str] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            pairs = [run[i : i + 2] for i in range(len(run) - 1)] if _is_cjk(run[0]) and len(run) > 1 else [run]
            out.extend(t for t in pairs if len(t.encode()) < TOKEN_BYTES)
        run = ""

    for c in text.lower():
        if unicodedata.category(c)[0] not in "LN":
            close()
            continue
        if run and _is_cjk(run[0]) != _is_cjk(c):
            close()
        run += c
    close()
    return [stem(t) for t in out] if stemmed else out


@dataclass(frozen=True)
class Clause:
    """A phrase (one term or more, adjacent) that must, should or must not occur."""

    terms: tuple[str, ...]
    occur: str  # "must", "should" or "not"


@dataclass(frozen=True)
class Group:
    clauses: tuple[Clause | Group, ...]
    occur: str


TOKEN = re.compile(r'\s*(?:([()+\-])|"([^"]*)"|([^\s()"]+))')


def parse_query(text: str, stemmed: bool = True) -> Group:
    """A query as clauses.

    Without a quotation mark: prose, any of its terms, repeated terms counting as often as they are repeated.  With one:
    phrases, AND, OR, NOT, + and -, and parentheses; what can't be parsed is prose.
    """
    prose = Group(tuple(Clause((t,), "should") for t in query_terms(text, stemmed)), "should")
    if '"' not in text:
        return prose
    try:
        if text.count('"') % 2:
            raise ValueError("an open quotation mark")
        tokens = [m.groups() for m in TOKEN.finditer(text) if any(g is not None for g in m.groups())]
        group, rest = _group(tokens, stemmed, "should")
        if rest:
            raise ValueError("an unmatched parenthesis")
    except ValueError:
        return prose
    return group


def _group(tokens: list, stemmed: bool, occur: str, depth: int = 0) -> tuple[Group, list]:
    parts: list[Clause | Group] = []
    sign, joined = None, None
    while tokens:
        (mark, phrase, word), tokens = tokens[0], tokens[1:]
        if mark == ")":
            if not depth:
                raise ValueError("an unmatched parenthesis")
            return Group(tuple(parts), occur), tokens
        if mark in ("+", "-"):
            sign = "must" if mark == "+" else "not"
            continue
        if word in ("AND", "OR", "NOT"):
            if word == "NOT":
                sign = "not"
            elif not parts:
                raise ValueError(f"nothing before {word}")
            else:
                joined = word
            continue
        how = sign or ("must" if joined == "AND" else "should")
        if joined == "AND" and parts and parts[-1].occur == "should":
            parts[-1] = type(parts[-1])(*(vars(parts[-1])[k] for k in vars(parts[-1]) if k != "occur"), "must")
        if mark == "(":
            part, tokens = _group(tokens, stemmed, how, depth + 1)
            parts.append(part)
        elif phrase is not None:
            if found := query_terms(phrase, stemmed):
                parts.append(Clause(tuple(found), how))
        elif word is not None:
            for t in query_terms(word, stemmed):
                parts.append(Clause((t,), how))
        sign = joined = None
    if depth or sign or joined:
        raise ValueError("an unfinished query")
    return Group(tuple(parts), occur), tokens


# English stemming: the published Porter2 rules.
_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
#: Fixed values of the published algorithm: words with stems of their own, and words left as they are.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Fixed values of the published algorithm: suffixes of steps 2, 3 and 4.
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _V and word[i - 1] in _V:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _V and word[1] not in _V
    return len(word) > 2 and word[-1] not in _V + "wxY" and word[-2] in _V and word[-3] not in _V


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words with other characters than a-z stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in "aeiou" or (i and word[i - 1] == "y")) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if any(c in _V for c in base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif base.endswith(_DOUBLE):
                        base = base[:-1]
                    elif _short_end(base) and r1 >= len(base):
                        base += "e"
                    w = base
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                before = w[: -len(end)]
                if end == "ogi":
                    w = before + to if before.endswith("l") else w
                elif end == "li":
                    w = before if before and before[-1] in _LI else w
                else:
                    w = before + to
            break
    # 3
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    # 4
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
                w = w[: -len(end)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
