"""Personal data: fixed patterns, and a conditional random field for what they do not cover."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.text import SOLID, Texts, in_batches, lean

KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def _of(chars: str) -> bytes:
    return bytes(1 if chr(i) in chars else 0 for i in range(256))


_AZ, _09 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_EMAIL_RUN, _IP_RUN, _CARD_RUN, _PHONE_RUN = _of(_AZ + _09 + "._%+-@"), _of(_09 + "."), _of(_09 + " -"), _of(_09 + " ().-+")
_DIGITS, _SIGNS = _of(_09), _of(_09 + "@+")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(run: bytes) -> Iterator[tuple[int, int]]:
    """Each @ with the characters since the one before it and the name that follows, as the leftmost
    matches take them; every byte is read once or twice."""
    free, at = 0, run.find(b"@")
    while at >= 0:
        m = _HOST.match(run, at + 1)
        if m and at > free:
            yield free, m.end()
        free = m.end() if m and at > free else at + 1
        at = run.find(b"@", max(free, at + 1))


def _ips(run: bytes) -> Iterator[tuple[int, int]]:
    """Four dotted numbers, as the leftmost matches take them; those over 255 are dropped."""
    at, parts = 0, run.split(b".")
    starts = []
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    i = 0
    while i + 4 <= len(parts):
        four = parts[i : i + 4]
        if all(four):
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                yield starts[i], starts[i + 3] + len(four[3])
            i += 4
        else:
            i += 1


def _cards(run: bytes) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(run):
        digits = m[0].replace(b" ", b"").replace(b"-", b"")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(run: bytes) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(run):
        if 10 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            yield m.span()


def base_spans(rows: Texts) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) in bytes of the row.  A match of a pattern lies within one run of
    the characters that the pattern can take, so patterns run over the few runs that hold enough
    of what they need."""
    if not rows.raw:
        return []
    data = np.frombuffer(rows.raw, np.uint8)
    counts = {name: np.concatenate([[0], np.cumsum(m)]) for name, m in (("digit", np.frombuffer(rows.raw.translate(_DIGITS), np.uint8)), ("@", data == 64), (".", data == 46), ("+", data == 43))}
    out = []
    for kind, (cls, needs, find) in enumerate(((_EMAIL_RUN, {"@": 1, ".": 1}, _emails), (_IP_RUN, {"digit": 4, ".": 3}, _ips), (_CARD_RUN, {"digit": 14}, _cards), (_PHONE_RUN, {"digit": 10, "+": 1}, _phones))):
        s, e, _ = rows.spans(cls)
        ok = np.ones(len(s), bool)
        for what, n in needs.items():
            ok &= counts[what][e] - counts[what][s] >= n
        for a, b in zip(s[ok].tolist(), e[ok].tolist(), strict=True):
            row = int(np.searchsorted(rows.offsets, a, "right")) - 1
            at = int(rows.offsets[row])
            out += [(row, a + x - at, a + y - at, kind) for x, y in find(rows.raw[a:b])]
    return out


# --- the field

#: What the field tells apart; of a secret (a key, a token, a password) there are no base matches.
FIELD_KINDS = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
#: Words on either side of a marked-up one that the field decodes with it.
REACH = 3
#: The labelled table: forms of each kind, and lines that a form stands in, x marking it.  9 stands for
#: any digit, a for any letter, h for a hexadecimal digit and x in a form for a letter or digit.
FORMS = {
    "phone": "(999) 999-9999|999-999-9999|999.999.9999|0999 999999|0999/9999999|09 99 99 99 99|(09) 9999 9999|999 999 9999|999 999 999|999-9999|00 99 999 9999999|09999 999999|0999-9999999|099-999999|099 9999 9999|09999/999999".split("|"),
    "email": "aaaa(at)aaaaa.aaa|aaa.aaa[at]aaaa.aaa|aaaa [at] aaaa.aaa|aaa.aaaa (at) aaaaaa.aaa|aaaa at aaaa dot aaa|aaaaa@localhost|aaa99(at)aaaa.aa.aa|aaa[at]aaaa.aa.aa|aaa (at) aaaa (dot) aa|aa_aa[at]aaaa[dot]aaa".split("|"),
    "ip": "9999:aaa9:99a9::9|aa99::9h99:99aa:aa99:9999|9h99:999::9|9999:9h9h:a999:9999:9999:9999:9999:9h9h|ha99::9|h99::ha|aa99::a9aa:aaaa:aa99:aa9a".split("|"),
    "card": "9999 9999 9999 9999|9999-9999-9999-9999|9999 999999 99999|9999999999999999|999999999999999".split("|"),
    "secret": "h" * 40 + "|" + "h" * 32 + "|" + "h" * 64 + "|sk-" + "x" * 24 + "|ghp_" + "x" * 30 + "|AKIA" + "X" * 16 + "|" + "x" * 22 + "|xoxb-999999999-" + "x" * 18,
}
FORMS["secret"] = FORMS["secret"].split("|")
LINES = {
    "phone": "call me on _ after six|phone _ or write|tel. _ ext|mobile: _|telefon _ im buero|tel _ merci|fax _ please|my number is _ ok|telefono _ gracias|call _ now|reach us at _|whatsapp _|cell: _ today|dial _ and ask|sms to _ or mail|hotline _ is free|Tel:_|text me at _ thanks|ruf _ an".split("|"),
    "email": "mail _ please|write to _ today|contact _ or call|email _ thanks|or _ then|ecrire a _ merci|e-mail: _|send it to _ soon|ask _ about it|reach me at _ any time".split("|"),
    "ip": "host _ answered|ipv6 _ up|ping _ failed|_ and|addr _|from _ to|route _ via|server _ is down|address: _".split("|"),
    "card": "card _ expires|visa _ was charged|credit card number _ and|mastercard: _|pay with card _ now|amex _ please".split("|"),
    "secret": "token = \"_\" end|api_key: _|password = _ here|secret: \"_\" in|key=\"_\"|token: _|export API_TOKEN=_|authorization: bearer _ sent|access_key = _ and".split("|"),
}
#: Lines without personal data; _ stands for any form of a phone, card, or number below.
PLAIN = "flight _ seats|order _ shipped|invoice _ total|isbn _ printed|id _ stored|sum _ of|page _ of it|price _ in all|row _ of the table|about _ people|code _ again|serial _ and|room _ upstairs|version _ was|on _ at last|chapter _ words|part _ of|between _ and then|score _ by half|rfc _ section|lines _ of the file|model _ and build|the year _ was good|weighs _ grams".split("|")
NUMBERS = "9999|99|9.99|99.99|999,999.99|9999-99-99|99:99:99|99/99/9999|99-99|v9.99.9|9.99.9|999999|a9 a99 a999|9a 99aa 9a|aa999|99%|999-a|9-9|9 99 9|99 99 99|9 9 9 9 9|999 of 9999|9999999999|999-9-99-999999-9|x+9|9:9|99:99".split("|")
HASHES = "commit _ merged|sha _ of it|md5 _ matches|checksum _ differs|revision _ was|digest _ of".split("|")
PROSE = "std::aaaa and aaa::aaaa9|a9:aa99 b|@aaaa said so|@@ 99|aaa@ aaa|row | 999 | 999 | 9999 ||c++ and 9+9|see 9. and 99.|in section 9, and|license, version 9.|on host 9 of 99|look at the dot and go|meet at noon at aaaa|sit at aaaa dot or aaaa|key = value of aaaa|the token = of aaaa|password is aaaa|call at 9 or 99|fax or mail|phone 9 times|tel 9|card 9 of 99|key: 99|call back in 99 days|mail 9 letters|from 9999 to 9999|host a9 is up|secret: none|be at the dot and wait|he is at a dot or so|look at it dot the aaaa".split("|")

_CUES = {w: c for c, words in {
    "phone": "phone tel telefon telefono téléphone mobile fax call whatsapp number cell dial sms hotline text reach ruf rufen anruf appelez llame", "mail": "mail email e-mail contact write ecrire send ask", "net": "host ip ipv6 server address addr ping route",
    "card": "card visa mastercard amex", "secret": "token api_key api_token password secret key access_key bearer apikey pwd passwd", "hash": "commit sha md5 checksum revision digest", "at": "at (at) [at]", "dot": "dot (dot) [dot]", "is": "= : is",
    "count": "flight order invoice isbn id sum page price row about code serial room version chapter part between score rfc lines model year weighs section of seats people", "on": "on me us my to or", "stop": "the a an and it go he she they this that",
}.items() for w in words.split()}
_RUN = re.compile(r"(.)\1*")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")


def _fill(form: str, draw: random.Random) -> str:
    """A form with its digits and letters drawn."""
    if re.fullmatch(r"[a-z@.]+|\[?\(?(at|dot)\)?\]?", form) and "9" not in form and form.strip("[]()") in ("at", "dot"):
        return form
    kinds = {"9": _09, "a": _AZ[:26], "h": "0123456789abcdef", "x": _AZ + _09, "X": _AZ[26:] + _09}
    marks = re.split(r"(\(at\)|\[at\]|\[dot\]|localhost|sk-|ghp_|AKIA|xoxb-)", form)
    return "".join(m if i % 2 else "".join(draw.choice(kinds[c]) if c in kinds else c for c in m) for i, m in enumerate(marks))


def labelled_rows(seed: int = 5, held_out: bool = False) -> list[tuple[list[str], list[int]]]:
    """The labelled table as words and labels: every form in some of its kind's lines, and what is no
    personal data.  The rows that are held out put forms into lines that the others leave out."""
    draw, out = random.Random(seed), []

    def add(line: str, form: str, kind: int | None) -> None:
        if (zlib.crc32(f"{line}/{form}".encode()) % 4 == 3) != held_out:
            return
        words, labels = [], []
        for w in line.split():
            if "_" not in w.replace("api_key", "").replace("API_TOKEN", "").replace("access_key", ""):
                words.append(w)
                labels.append(0)
                continue
            at = w.rindex("_")
            parts = [_fill(f, draw) for f in form.split()]
            parts[0], parts[-1] = w[:at] + parts[0], parts[-1] + w[at + 1 :]
            words += parts
            labels += [0 if kind is None else 1 + 2 * kind + (i > 0) for i in range(len(parts))]
        out.append((words, labels))

    for k, kind in enumerate(FIELD_KINDS):
        for form in FORMS[kind]:
            for line in LINES[kind]:
                add(line, form, k)
    clear = [f for f in FORMS["phone"] if f[0] == "(" or f in ("999-999-9999", "0999/9999999")]
    for line in ("and _ then", "so _ it is", "_", "see _ for more"):
        for form in clear:
            add(line, form, FIELD_KINDS.index("phone"))
    for line in PLAIN:
        for form in [*NUMBERS, *(f for f in FORMS["phone"] if f not in clear), *FORMS["card"]]:
            add(line, form, None)
    for line in HASHES:
        for form in FORMS["secret"][:3]:
            add(line, form, None)
    for line in PROSE:
        words = [w if w in _CUES or w.strip(":=") in _CUES else re.sub("9|a(?=a|9|:|@| |$)", lambda m: draw.choice(_09 if m[0] == "9" else _AZ[:26]), w) for w in line.split()]
        if (zlib.crc32(line.encode()) % 4 == 3) == held_out:
            out.append((words, [0] * len(words)))
    return out


def shape(word: str) -> str:
    """The word with digits as 9 and letters as a, runs of one kind with their length up to 4."""
    kinds = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word[:64])
    return _RUN.sub(lambda m: m[1] + str(min(len(m[0]), 4)) if m[1] in "9a" else m[1], kinds)


def _bare(word: str) -> str:
    """What is left of a word behind a key and its sign, without quotes and marks at its ends."""
    m = re.match(r"[A-Za-z_]{2,}[:=](?=[^:=])", word)
    return (word[m.end() :] if m and ":" not in word[m.end() :] else word).strip(".,;:!?\"'#$%&*")


def cue_of(word: str) -> str:
    """The class of a word that tells what stands next to it."""
    if word in _CUES:
        return _CUES[word]
    low = word.lower().strip(".,;:!?\"'#$%&*")
    return _CUES.get(low, "-")


def kind_of(word: str) -> str:
    """Digits, digits and letters, a sign, or a plain word."""
    bare = _bare(word)
    if not any(c.isalnum() for c in word):
        return "="
    if not any("0" <= c <= "9" for c in bare):
        return "@" if "@" in bare or "(at)" in bare or "[at]" in bare else "w"
    return "m" if any(c.isalpha() for c in bare) else "d"


def word_features(word: str) -> list[str]:
    """Features of a word by itself."""
    bare = _bare(word)
    digits = sum("0" <= c <= "9" for c in bare)
    own = re.match(r"[A-Za-z_]{2,}(?=[:=])", word)
    kind = kind_of(word)
    out = [f"s={shape(bare)}" if kind != "w" else "s=word", f"k={kind}", f"n={min(digits, 16)}", f"len={min(len(bare).bit_length(), 7)}", f"at={'@' in bare or '(at)' in bare or '[at]' in bare}", f"col={min(bare.count(':'), 3)}", f"par={bare[:1] == '('}", f"end={word[-1:] in '.,;'}", f"own={cue_of(own[0]) if own else '-'},{kind}", f"self={cue_of(word)}"]
    if _HEX.fullmatch(bare):
        out.append(f"hex={min(len(bare) // 16, 4)}")
    elif len(bare) >= 16 and digits and kind == "m":
        out.append("long")
    return [*out, f"dots={bare.count('.') > 0},{kind}"]


def _around(cue: str, two: str, after: str, before_kind: str, kind: str, after_kind: str) -> list[str]:
    """Features of the words next to one."""
    return [f"c1={cue}", f"c1={cue},k={kind}", f"c2={two},k={kind}", f"a1={after},k={kind}", f"pk={before_kind},{kind}", f"nk={after_kind},{kind}"]


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def scores(self, features: list[str]) -> np.ndarray:
        at = [self.index[f] for f in features if f in self.index]
        return self.emit[at].sum(0) if at else np.zeros(len(LABELS))


def _marked(word: str) -> bool:
    return any("0" <= c <= "9" or c in "@+" for c in word) or "(at)" in word or "[at]" in word or word == "dot" or _KEYED.search(word) is not None


#: Keys that a secret follows, as bytes and as words.
_KEYS = ("token", "api_key", "password", "secret", "passwd", "bearer", "access_key", "apikey")
_KEYED = re.compile("|".join(_KEYS), re.IGNORECASE)


def _dilated(hot: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words within REACH of a marked-up one in the same row, and which of them begin a sequence."""
    idx = np.flatnonzero(hot)
    idx = np.unique((idx[:, None] + np.arange(-REACH, REACH + 1)).clip(0, max(len(hot) - 1, 0))[row[(idx[:, None] + np.arange(-REACH, REACH + 1)).clip(0, max(len(hot) - 1, 0))] == row[idx][:, None]]) if len(idx) else idx
    new = np.concatenate([[True], (idx[1:] != idx[:-1] + 1) | (row[idx[1:]] != row[idx[:-1]])]) if len(idx) else np.zeros(0, bool)
    return idx, new


_ALLOWED = np.zeros((len(LABELS) + 1, len(LABELS)))
for _i, _a in enumerate((*LABELS, "O")):
    for _j, _b in enumerate(LABELS):
        if _b[0] == "I" and _a[1:] != _b[1:]:
            _ALLOWED[_i, _j] = -1e4


def _sentence_features(words: list[str]) -> list[list[str]]:
    cues, kinds = ["-", "-", *map(cue_of, words), "-"], ["b", *map(kind_of, words), "b"]
    return [word_features(w) + _around(cues[i + 1], cues[i], cues[i + 3], kinds[i], kinds[i + 1], kinds[i + 2]) for i, w in enumerate(words)]


def train_field(rows: list[tuple[list[str], list[int]]], rounds: int = 80, l2: float = 0.02) -> Field:
    """Maximum likelihood by gradient steps with momentum estimates; sums over label sequences by
    the forward and backward recursions, for all rows side by side.  The words within REACH of marked-up
    ones are the sequences, as in decoding."""
    seqs = []
    for words, labels in rows:
        fs = _sentence_features(words)
        idx, new = _dilated(np.array([_marked(w) for w in words], bool), np.zeros(len(words), np.int64))
        for run in np.split(idx, np.flatnonzero(new)[1:]) if len(idx) else []:
            seqs.append(([tuple(fs[i]) for i in run], [labels[i] for i in run]))
    kinds: dict[tuple, int] = {}
    many: dict[tuple, int] = {}  # equal sequences are one, with a weight
    for fs, ls in seqs:
        key = tuple(kinds.setdefault(f, len(kinds)) for f in fs), tuple(ls)
        many[key] = many.get(key, 0) + 1
    index = {f: i for i, f in enumerate(sorted({f for fs in kinds for f in fs}))}
    of_kind = np.zeros((len(kinds), len(index)), np.float32)
    for fs, i in kinds.items():
        of_kind[i, [index[f] for f in fs]] = 1
    n, longest, k = len(many), max(len(ls) for _, ls in many), len(LABELS)
    x, y, on = np.zeros((n, longest), int), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (fs, ls) in enumerate(many):
        x[i, : len(fs)], y[i, : len(ls)], on[i, : len(ls)] = fs, ls, True
    weight = np.array(list(many.values()), float)
    emit, step = np.zeros((len(index), k)), np.zeros((k + 1, k))  # the last row of step is the start
    moments = [[np.zeros_like(emit), np.zeros_like(emit)], [np.zeros_like(step), np.zeros_like(step)]]

    def by_feature(p: np.ndarray) -> np.ndarray:
        return of_kind.T @ np.stack([np.bincount(x[on], p[..., j][on], len(kinds)) for j in range(k)], 1)

    gold_e, gold_s = by_feature(np.eye(k)[y] * weight[:, None, None]), np.zeros_like(step)
    np.add.at(gold_s, (np.full(n, k), y[:, 0]), weight)
    for t in range(1, longest):
        np.add.at(gold_s, (y[on[:, t], t - 1], y[on[:, t], t]), weight[on[:, t]])

    for r in range(1, rounds + 1):
        e = (of_kind @ emit)[x]
        local = np.exp(e - e.max(2, keepdims=True))  # recursions on probabilities, scaled to sum to 1
        move, start = np.exp(step + _ALLOWED)[:k], np.exp(step + _ALLOWED)[k]
        alpha, beta, scale = np.zeros((longest, n, k)), np.ones((longest, n, k)), np.ones((longest, n, 1))
        for t in range(longest):
            a = (start if t == 0 else alpha[t - 1] @ move) * local[:, t]
            scale[t] = a.sum(1, keepdims=True)
            alpha[t] = a / scale[t] if t == 0 else np.where(on[:, t, None], a / scale[t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            beta[t] = np.where(on[:, t + 1, None], (local[:, t + 1] * beta[t + 1] / scale[t + 1]) @ move.T, 1.0)
        p = (alpha * beta).swapaxes(0, 1) * (on * weight[:, None])[..., None]
        got_s = np.zeros_like(step)
        got_s[k] = p[:, 0].sum(0)
        for t in range(1, longest):
            got_s[:k] += move * (alpha[t - 1].T @ (local[:, t] * beta[t] / scale[t] * (on[:, t] * weight)[:, None]))
        for w, g, m in ((emit, gold_e - by_feature(p) - l2 * emit, moments[0]), (step, gold_s - got_s - l2 * step, moments[1])):
            m[0] *= 0.9
            m[0] += 0.1 * g
            m[1] *= 0.99
            m[1] += 0.01 * g * g
            w += 0.15 * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-8)
    return Field(index, emit, step + _ALLOWED)


def viterbi(emit: np.ndarray, first: np.ndarray, step: np.ndarray, after_o: np.ndarray | None = None, before_o: np.ndarray | None = None) -> np.ndarray:
    """Best labels of sequences emit[first[i]:first[i + 1]], decoded side by side, longest first.  Those
    of ``after_o`` come behind a word that is O, those of ``before_o`` in front of one."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    out, back = np.zeros(len(emit), np.int64), np.zeros(emit.shape, np.int8)
    k = emit.shape[1]
    start, end = np.stack([step[k], step[0]]), np.stack([np.zeros(k), step[:k, 0]])
    of_start = np.zeros(len(n), np.int64) if after_o is None else after_o.astype(np.int64)
    of_end = np.zeros(len(n), np.int64) if before_o is None else before_o.astype(np.int64)
    long = order[n[order] > LONG]
    for i in long.tolist():
        out[first[i] : first[i + 1]] = viterbi_blocks(emit[first[i] : first[i + 1]], step, start[of_start[i]], end[of_end[i]])
    order = order[len(long) :]
    live, t, score = order[n[order] > 0], 0, None
    while len(live):
        at = first[live] + t
        if t == 0:
            score = start[of_start[live]] + emit[at]
        else:
            paths = score[: len(live), :, None] + step[None, :k]
            back[at] = paths.argmax(1)
            score = paths.max(1) + emit[at]
        done = n[live] == t + 1
        if done.any():
            out[at[done]] = (score[done] + end[of_end[live[done]]]).argmax(1)
            score, live = score[~done], live[~done]
        t += 1
    for t in range(int(n[order].max(initial=0)) - 1, 0, -1):
        own = order[: np.searchsorted(-n[order], -t)]
        at = first[own] + t
        out[at - 1] = back[at, out[at]]
    return out


#: A longer sequence is decoded in blocks of about the root of its length, side by side.
LONG = 4_096


def viterbi_blocks(emit: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best labels of one long sequence.  For every block and label before it the best paths to each label
    at its end are found for all blocks at once; then the blocks are joined, and read backwards."""
    n, k = emit.shape
    size = int(n**0.5) + 1
    blocks = -(-n // size)
    padded = np.zeros((blocks * size, k))
    padded[:n] = emit
    real = (np.arange(blocks * size) < n).reshape(blocks, size)
    e = padded.reshape(blocks, size, k)
    score = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(blocks, 0)  # label before, label now
    back = np.zeros((size, blocks, k, k), np.int8)
    keep = np.broadcast_to(np.arange(k, dtype=np.int8), (blocks, k, k))
    for t in range(size):
        paths = score[:, :, :, None] + step[None, None, :k]
        if t == 0:  # the first word of all has no label before it: any row of the start will do
            paths[0] = np.where(np.eye(k, dtype=bool)[:, :, None], start[None, None, :], -np.inf)
        on = real[:, t][:, None, None]
        back[t] = np.where(on, paths.argmax(2), keep)
        score = np.where(on, paths.max(2) + e[:, t][:, None, :], score)
    total, come = np.zeros(k), np.zeros((blocks, k), np.int64)
    for b in range(blocks):
        paths = total[:, None] + score[b]
        come[b], total = paths.argmax(0), paths.max(0)
    labels, now = np.zeros((blocks, size), np.int64), int((total + end).argmax())
    last, before = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    for b in range(blocks - 1, -1, -1):
        last[b], before[b] = now, come[b, now]
        now = int(before[b])
    at = last
    every = np.arange(blocks)
    for t in range(size - 1, -1, -1):
        labels[:, t] = at
        at = back[t, every, before, at].astype(np.int64)
    return labels.reshape(-1)[:n]


def certain_o(emit: np.ndarray, last: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Words that are O on the best path whatever stands around them; ``last`` marks the ends of
    sequences.  Were such a word in a span, making it O, and the rest of the span behind it a span of its
    own, would gain more by the word's scores than transitions and the next word's can lose."""
    k = emit.shape[1]
    s = np.where(step < -1e3, -np.inf, step)
    lead = np.array([(s[:, j] - s[:, 0]).max() for j in range(k)])
    gain = np.full(emit.shape, -np.inf)
    follow = np.concatenate([emit[1:], np.zeros((1, k))])
    for j in range(1, k):
        inside = j + 1 if j % 2 == 1 else j  # the label that goes on with the span
        others = [b for b in range(k) if b != inside and np.isfinite(s[j, b]) and np.isfinite(s[0, b])]
        plain = max([0.0, *(s[j, b] - s[0, b] for b in others)])
        free = np.isfinite(s[inside])
        on = s[j, inside] - s[0, inside - 1] + max(0.0, (s[inside, free] - s[inside - 1, free]).max())
        goes_on = np.where(last, -np.inf, on + follow[:, inside] - follow[:, inside - 1])
        gain[:, j] = emit[:, j] + lead[j] + np.maximum(plain, goes_on)
    return emit[:, 0] > gain.max(1)


def decode(emit: np.ndarray, new: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels of the sequences that begin at ``new``.  They are cut at words that are certain to be
    O, which changes nothing but the number of steps one after another."""
    last = np.append(new[1:], True)
    sure = certain_o(emit, last, step)
    out = np.zeros(len(emit), np.int64)
    idx = np.flatnonzero(~sure)
    if len(idx):
        begins = new[idx] | np.concatenate([[True], idx[1:] != idx[:-1] + 1])
        ends = np.append(begins[1:], True)
        out[idx] = viterbi(emit[idx], np.append(np.flatnonzero(begins), len(idx)), step, ~new[idx[begins]], ~last[idx[ends]])
    return out


def _emissions(words: list[str], uid: np.ndarray, idx: np.ndarray, row: np.ndarray, field: Field) -> np.ndarray:
    """Scores of the labels of the words idx (positions; uid tells which of the distinct ``words`` stands
    at each position near them), by tables of what a word adds itself and what its neighbours add."""
    cues, kinds = sorted({*_CUES.values(), "-"}), ["w", "d", "m", "@", "=", "b"]
    own = np.stack([field.scores(word_features(w)) for w in words]) if words else np.zeros((0, len(LABELS)))
    cue, kind = np.array([cues.index(cue_of(w)) for w in words], np.int64), np.array([kinds.index(kind_of(w)) for w in words], np.int64)
    none, edge = cues.index("-"), kinds.index("b")

    def at(off: int, of: np.ndarray, outside: int) -> np.ndarray:
        j = (idx + off).clip(0, len(uid) - 1)
        return np.where((idx + off == j) & (row[j] == row[idx]), of[uid[j]], outside)

    def of_pairs(name: str, left: list[str]) -> np.ndarray:
        return np.array([[field.scores([name.format(c, k)]) for k in kinds] for c in left])

    me, before, two, after = kind[uid[idx]], at(-1, cue, none), at(-2, cue, none), at(1, cue, none)
    out = own[uid[idx]] + np.array([field.scores([f"c1={c}"]) for c in cues])[before]
    out += of_pairs("c1={},k={}", cues)[before, me] + of_pairs("c2={},k={}", cues)[two, me] + of_pairs("a1={},k={}", cues)[after, me]
    return out + of_pairs("pk={},{}", kinds)[at(-1, kind, edge), me] + of_pairs("nk={},{}", kinds)[at(1, kind, edge), me]


def _trimmed(raw: bytes, a: int, b: int, kind: str) -> tuple[int, int]:
    """A span without keys, quotes and marks at its ends."""
    m = re.match(rb"[A-Za-z_]{2,}[:=](?=[^:=])", raw[a:b]) if kind != "ip" else None
    a += m.end() if m else 0
    opens, closes = {"phone": (b"(+", b")"), "ip": (b":", b":")}.get(kind, (b"", b""))
    while b > a and not (chr(raw[b - 1]).isalnum() or raw[b - 1] in closes):
        b -= 1
    while a < b and not (chr(raw[a]).isalnum() or raw[a] in opens):
        a += 1
    return a, b


def field_spans(rows: Texts, field: Field) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) of the spans the field finds.  A word is marked up if it has a digit, an
    @ or +, a bracketed or spelt-out sign, or a key that secrets follow.  Sequences are the words up to
    REACH away from those, plain words among them; words farther off are outside of personal data by
    the model's definition.  Every sequence is decoded as a whole."""
    s, e, first = rows.spans(SOLID)
    if not len(s):
        return []
    signs = np.concatenate([[0], np.cumsum(np.frombuffer(rows.raw.translate(_SIGNS), np.uint8))])
    hot = signs[e] > signs[s]
    low = rows.raw.lower()
    for mark in (b"(at)", b"[at]", b" dot ", *(k.encode() for k in _KEYS)):
        at = low.find(mark)
        while at >= 0:
            hot[np.searchsorted(s, at + (mark[0] == 32), "right") - 1] = True
            at = low.find(mark, at + 1)
    if not hot.any():
        return []
    row = np.repeat(np.arange(rows.rows), np.diff(first))
    idx, new = _dilated(hot, row)
    near = np.unique((idx[:, None] + np.arange(-2, 2)).clip(0, len(s) - 1))
    found: dict[bytes, int] = {}
    uid = np.zeros(len(s), np.int64)
    uid[near] = [found.setdefault(rows.raw[a:b], len(found)) for a, b in zip(s[near].tolist(), e[near].tolist(), strict=True)]
    words = [w[:256].decode(errors="replace") for w in found]
    labels = decode(_emissions(words, uid, idx, row, field), new, field.step)
    out = []
    begins = np.flatnonzero(labels % 2 == 1)
    for i in begins.tolist():
        j = i + 1
        while j < len(idx) and labels[j] == labels[i] + 1 and not new[j]:
            j += 1
        kind, base = int(labels[i]) // 2, int(rows.offsets[row[idx[i]]])
        a, b = _trimmed(rows.raw, int(s[idx[i]]), int(e[idx[j - 1]]), FIELD_KINDS[kind])
        if b > a:
            out.append((int(row[idx[i]]), a - base, b - base, kind))
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{FIELD_KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for a, b, k in spans))


def _apart(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``more`` that overlap none of ``base`` and none before them."""
    taken = sorted((a, b) for a, b, _ in base)
    starts, furthest, end = [a for a, _ in taken], [], 0
    for _, b in taken:  # the furthest end of all spans up to each one, as kinds may overlap
        end = max(end, b)
        furthest.append(end)
    out, last = [], 0
    for a, b, k in sorted(more):
        i = bisect.bisect_left(starts, b)
        if a >= last and (i == 0 or furthest[i - 1] <= a):
            out.append((a, b, k))
            last = b
    return out


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long"


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base matches),
    base_sha256, spans (all, as kind:start:end in code points), n_added (those the field adds),
    n_secret (of which are keys, tokens and passwords), n_spans (all).

    Base matches are the leftmost non-overlapping matches of four patterns that pass their tests.
    The field adds spans that overlap none of them (phone numbers without a plus sign, addresses
    written out, IPv6, cards that are called so, secrets); base matches always stay.  It is trained on
    the driver from the labelled table of this module.  Null texts are empty; texts are whole whatever
    their length, and time follows it; rows that repeat answer alike; other columns are ignored; an
    empty table gives no rows.
    """
    field = field or train_field(labelled_rows())
    secret = FIELD_KINDS.index("secret")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, more = np.zeros((batch.num_rows, 4), np.int64), np.zeros((batch.num_rows, 3), np.int64)
            base, every = [""] * batch.num_rows, [""] * batch.num_rows
            for a0, rows in Texts.of(batch.column(1)).chunks(1_000_000):
                sure, added = {}, {}
                for r, a, b, k in base_spans(rows):
                    sure.setdefault(r, []).append((a, b, k))
                for r, a, b, k in field_spans(rows, field):
                    added.setdefault(r, []).append((a, b, k))
                for r in {*sure, *added}:
                    raw = np.frombuffer(rows.raw[rows.offsets[r] : rows.offsets[r + 1]], np.uint8)
                    points = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
                    fixed = [(int(points[a]), int(points[b]), k) for a, b, k in sure.get(r, ())]
                    new = [(int(points[a]), int(points[b]), k) for a, b, k in _apart(sure.get(r, []), added.get(r, []))]
                    n[a0 + r] = np.bincount([k for _, _, k in fixed], minlength=4) if fixed else 0
                    more[a0 + r] = len(new), sum(k == secret for _, _, k in new), len(fixed) + len(new)
                    base[a0 + r], every[a0 + r] = _digest(fixed), _digest([*fixed, *new])
            shas = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            arrays = [batch.column(0), *[pa.array(n[:, k]) for k in range(4)], pa.array(shas), pa.array(every), *[pa.array(more[:, k]) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in FOUND.split(", ")])

    return in_batches(docs).select("doc_id", "text").mapInArrow(lean(task), FOUND)
