"""Personal data and secrets: a linear-chain conditional random field over word shapes.

Every token (a run of characters other than white space and a few separators, or an equals sign) is a link of its text's
chain. Its score for each label adds up weights of features of its own form, of the two tokens before and of the one after,
and, for runs of printed groups, of its part in them. Features are of shape: classes of characters, runs, lengths, counts,
beginnings; besides these there are two properties that no shape tells, the check digit of 13 to 19 digits and whether the
numbers between three dots are below 256. The model is trained here, by gradient ascent on a small labelled table that is
written by rule (:func:`labelled_table`).

Decoding is Viterbi over numpy batches, and exact: a token whose score for ``O`` exceeds that of any other label by more
than the transitions before and after it could ever make good is ``O`` on the best path, whatever its neighbours are. Such
tokens part a chain into segments that are decoded apart without loss, those of one length as one batch.

Kinds: EMAIL, PHONE, IP, CARD (13 to 19 digits with a right check digit), SECRET (keys and tokens), SSN, IBAN.

Defined cases: null texts stay null and have no spans; empty texts have none; an empty table has no rows; texts and tokens
of any length are read whole, in time that grows in proportion to them; repeated rows are treated alike; of equally good
labels the first in ``LABELS`` counts; columns other than the text are carried unread.
"""

from __future__ import annotations

import random
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import small_batches

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TOKEN = re.compile("[^\\s\"'<>=|,;]+|=")
_CLASSES = {c: "0" for c in string.digits} | {c: "x" for c in string.ascii_lowercase} | {c: "X" for c in string.ascii_uppercase}
_PLAIN = str.maketrans(_CLASSES)
_OTHER = re.compile(r"[^\W\d_X]"), re.compile(r"\d")
_ODD = re.compile("[a-z][A-Z]|[A-Z][a-z]+[A-Z]|[bcdfghj-np-tv-zBCDFGHJ-NP-TV-Z]{6}")
#: Names of secrets, two classes of them.
_NAMES = re.compile(r"(?<![^\W_])(pass|pwd|secret|token|(?:api)?key)")
_RUNS = re.compile(r"(.)\1*", re.S)
SPANS = "array<struct<start: int, end: int, kind: string>>"
#: Tokens whose scores a worker keeps, and tokens scored at a time.
MAX_KEPT, BATCH = 400_000, 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def core_of(token: str) -> tuple[int, int]:
    """Where a token begins and ends without the signs around it."""
    start, end = 0, len(token)
    while start < end and not (token[start].isalnum() or token[start] in "_+("):
        start += 1
    while end > start and not (token[end - 1].isalnum() or token[end - 1] in "_)"):
        end -= 1
    return start, end


def _core(token: str) -> str:
    start, end = core_of(token)
    return token[start:end]


def _shape(word: str) -> str:
    """Letters as x or X, digits as 0."""
    word = word.translate(_PLAIN)
    return word if word.isascii() else _OTHER[0].sub("x", _OTHER[1].sub("0", word))


def groups_of(tokens: list[str]) -> list[str]:
    """For each of neighbouring tokens its part in a card or an IBAN in printed groups, or nothing."""
    out = [""] * len(tokens)
    cores = [_core(t) for t in tokens]
    i = 0
    while i < len(cores) - 1:
        end, kind = 0, ""
        if re.fullmatch(r"[A-Z]{2}\d{2}", cores[i]):
            j, n = i + 1, 4
            while j < len(cores) and re.fullmatch(r"[A-Z0-9]{4}", cores[j]) and n < 32:
                n, j = n + 4, j + 1
            if j < len(cores) and re.fullmatch(r"(?=.*\d)[A-Z0-9]{1,3}", cores[j]) and n >= 12:
                n, j = n + len(cores[j]), j + 1
            end, kind = (j, "iban") if 15 <= n <= 34 else (0, "")
        elif re.fullmatch(r"[0-9]{4}", cores[i]) and not (i and re.fullmatch(r"[0-9]{4}", cores[i - 1])):
            digits = cores[i]
            for j in range(i + 1, min(len(cores), i + 5)):
                if not re.fullmatch(r"[0-9]{1,7}", cores[j]):
                    break
                digits += cores[j]
                if 13 <= len(digits) <= 19 and luhn(digits) and not end:
                    end, kind = j + 1, "card"
                if len(cores[j]) < 4:
                    break
        for j in range(i, end):
            out[j] = f"{'I' if j > i else 'B'}{kind}"
        i = max(end, i + 1)
    return out


def _group_kind(core: str) -> int:
    """1 and 3 may begin printed groups (digits, IBAN), 2 and 4 go on with them, 0 is in none."""
    if not 0 < len(core) < 8 or not core.isascii() or not core.isalnum() or core.upper() != core:
        return 0
    if core.isdigit():
        return 1 if len(core) == 4 else 2
    return 3 if re.fullmatch(r"[A-Z]{2}\d{2}", core) else 4 if len(core) <= 4 else 0


def _odd(word: str) -> bool:
    """Letters in an order that words do not have: capitals within, or six consonants together."""
    return _ODD.search(word) is not None


def features(token: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """Names of a token's features: its own, and those it lends the next token, the one after that and the one before."""
    core = _core(token)
    shape = _shape(core)
    runs = [(m[1], m.end() - m.start()) for m in _RUNS.finditer(shape)]
    kind = "".join(c for c, _ in runs)
    whole = "".join(c + (str(min(n, 9)) if c == "0" else "") for c, n in runs)
    digits, letters = shape.count("0"), shape.count("x") + shape.count("X")
    alone = ["bias", f"s={whole}", f"k={kind}", f"n={min(digits, 20)}", f"l={min(len(core) // 4, 12)}", f"b={core[:1] if not core[:1].isalpha() else 'x'}", f"h={_shape(core[:2]) if digits else ''}"]
    if "@" in core:
        name, _, host = core.partition("@")
        alone += ["at", f"at={bool(name)}{min(host.count('.'), 3)}{'@' in host}", f"top={_shape(host.rpartition('.')[2])[:4]}"]
    if digits and letters:
        ends = sum(a != b and {a, b} != {"x", "X"} for a, b in zip(kind, kind[1:], strict=False) if a in "0xX" and b in "0xX")
        low = core.lower()
        alone += [f"turns={min(ends, 6)}", f"mix={min(len(core) // 8, 5)}{digits * 4 >= len(core)}", f"hex={min(sum(c in '0123456789abcdef' for c in low) * 8 // len(core), 8)}{min(len(core) // 8, 5)}", f"case={'X' in kind}{'x' in kind}{min(len(core) // 8, 4)}"]
        alone.append(f"begins={core[:4] if not any(c.isdigit() for c in core[:4]) else '0'}")
        if len(core) > 11 and core.isalnum():
            alone.append(f"head={_shape(core[:5])}{min((len(core) - digits), 6)}")
    elif digits:
        if 13 <= digits <= 19 and kind in ("0", "0-0-0-0", "0-0-0", "0-0-0-0-0"):
            alone.append(f"check={luhn(''.join(c for c in core if c.isdigit()))}")
        if kind == "0.0.0.0":
            alone.append(f"below={all(n < 4 and int(x) < 256 for x in core.split('.') for n in [len(x)])}")
    elif letters:
        alone += ["letters", f"odd={_odd(core)}{min(len(core) // 8, 3)}", f"long={len(core) > 5}{len(core) > 11}"]
    word, colon = core.lower(), token.endswith(":")
    after, later = [f"p={kind}", f"ps={whole}", f"pw={word}", f"p:{word if colon else colon}"], [f"2={word}", f"2k={kind[:4]}"]
    if m := _NAMES.search(word):
        name = "pass" if m[0] in ("pass", "pwd") else "other"
        after, later = [*after, f"pn={name}{colon}"], [*later, f"2n={name}"]
    return alone, after, later, [f"q={kind}", f"qs={whole}"]


class Scores(dict):
    """Rows of scores by token, remembered while there are few enough. Plain words of one form share a row."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.forms: dict[str, int] = {}
        self.count = 1  # row 0 is nothing: the place between texts
        self.rows = np.zeros((1024, 4, len(LABELS)))
        self.kinds = np.zeros(1024, np.int8)

    def __missing__(self, token: str) -> int:
        form, (start, end) = None, core_of(token)
        core = token[start:end]
        if core.isalpha() and core.lower() not in self.model.lexicon and not _NAMES.search(core.lower()):
            form = _shape(core), _odd(core), token.endswith(":")
            if (row := self.forms.get(form)) is not None:
                self[token] = row
                return row
        row = self.count
        self.count += 1
        if row == len(self.rows):
            self.rows, self.kinds = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        for k, names in enumerate(features(token)):
            own = [self.model.names[f] for f in names if f in self.model.names]
            if own:
                self.rows[row, k] = self.model.emit[own].sum(axis=0)
        self.kinds[row] = _group_kind(core) if len(token) < 16 else 0
        if form is not None:
            self.forms[form] = row
        self[token] = row
        return row


class Model:
    """Weights by feature name and label, transitions (row: from), start and end as from and to ``O``."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self.lexicon = {f[3:] for f in names if f.startswith("pw=")} | {f[2:] for f in names if f.startswith("2=")}
        self.group = {g: emit[names[f"g={g}"]] if f"g={g}" in names else np.zeros(len(LABELS)) for g in ("Bcard", "Icard", "Biban", "Iiban")}
        #: What a label other than ``O`` can gain at most by the transitions to and from it.
        self.most = (move - move[:, :1]).max(axis=0) + (move - move[:1]).max(axis=1)
        self.scores: Scores | None = None

    def __getstate__(self):
        return self.names, self.emit, self.move

    def __setstate__(self, state):
        self.__init__(*state)


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of segments (batch, length, labels) between two ``O``."""
    n, length, _ = scores.shape
    best = scores[:, 0] + move[0]
    back = np.zeros(scores.shape, np.int32)
    for t in range(1, length):
        paths = best[:, :, None] + move[None]
        back[:, t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + scores[:, t]
    labels = np.zeros((n, length), np.int64)
    labels[:, -1] = (best + move[:, 0]).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        labels[:, t - 1] = back[np.arange(n), t, labels[:, t]]
    return labels


def emissions(model: Model, rows: np.ndarray, tokens: list[str | None]) -> np.ndarray:
    """Scores of tokens by their ``rows``; places between texts are row 0 and have no token."""
    table = model.scores.rows
    out = table[rows, 0]
    out[1:] += table[rows[:-1], 1]
    out[2:] += np.where(rows[1:-1, None] > 0, table[rows[:-2], 2], 0.0)
    out[:-1] += table[rows[1:], 3]
    kinds = model.scores.kinds[rows]
    begins = np.flatnonzero(((kinds[:-1] == 1) & np.isin(kinds[1:], (1, 2))) | ((kinds[:-1] == 3) & (kinds[1:] > 0)))
    done = 0
    for i in begins:
        if i < done:
            continue
        while i and kinds[i - 1]:
            i -= 1
        done = i
        while done < len(kinds) and kinds[done]:
            done += 1
        for k, part in enumerate(groups_of(tokens[i:done])):
            if part:
                out[i + k] += model.group[part]
    return out


def decode(model: Model, scores: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Labels of a run of chains, which the places ``between`` texts part."""
    sure = between | ((scores + model.most)[:, 1:].max(axis=1) < scores[:, 0])
    labels = np.zeros(len(scores), np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sure, [True])).astype(np.int8)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    for length in np.unique(lengths):
        which = starts[lengths == length]
        step = max(1, 20_000 // int(length))
        for k in range(0, len(which), step):
            places = which[k : k + step, None] + np.arange(length)
            labels[places] = viterbi(scores[places], model.move)
    return labels


def find(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text, without the signs around them."""
    if model.scores is None:
        model.scores = Scores(model)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    held: list[tuple[int, list[str]]] = []
    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        held.append((i, _TOKEN.findall(text)))
        size += len(held[-1][1])
        if size >= BATCH:
            _label(model, texts, held, out)
            held, size = [], 0
    _label(model, texts, held, out)
    return out


def _label(model: Model, texts: list[str | None], held: list[tuple[int, list[str]]], out: list) -> None:
    """Fill in the spans of the texts held: a place between texts stands before each and after the last."""
    if not held:
        return
    if len(model.scores) > MAX_KEPT:
        model.scores.begin()
    tokens: list[str | None] = [None]
    rows = [0]
    for _, own in held:
        tokens += own
        tokens.append(None)
        rows.extend(map(model.scores.__getitem__, own))
        rows.append(0)
    where = np.array(rows)
    between = where == 0
    labels = decode(model, emissions(model, where, tokens), between)
    if not labels.any():
        return
    at = 1
    for i, own in held:
        found = labels[at : at + len(own)]
        at += len(own) + 1
        if not found.any():
            continue
        open_kind = None
        for m, y in zip(_TOKEN.finditer(texts[i]), found, strict=True):
            prefix, _, kind = LABELS[y].partition("-")
            if not kind:
                open_kind = None
                continue
            start, end = core_of(m[0])
            s = m.start() + start
            if prefix == "I" and open_kind == kind and out[i]:
                s = out[i].pop()[0]
            open_kind = kind
            if s < m.start() + end:
                out[i].append((s, m.start() + end, kind))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*parts, text[at:]])


# The labelled table and the training


def _written(seed: int, count: int) -> list[list[tuple[str, str]]]:
    """Sentences as lists of (token, label)."""
    r = random.Random(seed)
    syllables = "an be co de er fi ga ho in ja ko la mi no or pa qu re st th ung tion lich eau ment ción".split()
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4))) + r.choice(["", "", "", ".", ","])
    hexes = lambda n: (lambda x: x if re.search(r"\d", x) and re.search("[a-f]", x) else "a1" + x[2:])("".join(r.choice("0123456789abcdef") for _ in range(n)))

    def card(valid: bool) -> str:
        body = r.choice("0123456789") + digits(r.choice([14, 14, 14, 13, 12, 17]))
        right = next(c for c in string.digits if luhn(body + c))
        return body + (right if valid else str((int(right) + r.randint(1, 9)) % 10))

    def host() -> str:
        labels = [r.choice(syllables).replace("é", "e").encode("ascii", "ignore").decode() + r.choice(["", r.choice(syllables), digits(1), "-" + r.choice(syllables)]) for _ in range(r.randint(1, 3))]
        return ".".join([*labels, r.choice("com org net de fr es io uk eu info edu gov co".split())])

    def noise() -> str:
        return r.choice(["", "", "", "", "", ".", ".", "!", "?", "...", ")", ":", "".join(r.choices("#*%&$!~^/\\-_", k=r.randint(1, 4)))])

    def email() -> str:
        name = r.choice([word().strip(".,"), word().strip(".,") + "." + digits(r.randint(1, 3)), word().strip(".,") + "_" + word().strip(".,"), word().strip(".,") + digits(2)])
        return f"{name}@{host()}"

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([[f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{r.randint(1, 99)}-{a}-{b}-{c}"], [f"+{r.randint(1, 99)}", a, b, c], [f"+{r.randint(1, 99)}{a}{b}{c}"], [f"{a}.{b}.{c}"]])

    secret = lambda: r.choice([hexes(40), hexes(40).upper(), hexes(32), hexes(64), "AKIA" + "".join(r.choices(string.ascii_uppercase + string.digits, k=15)) + digits(1), "sk-" + "".join(r.choices(string.ascii_letters + string.digits, k=30)) + digits(2), "ghp_" + "".join(r.choices(string.ascii_letters + string.digits, k=34)) + digits(2)])
    letters = lambda: "".join(r.choices(r.choice([string.ascii_letters, string.ascii_letters, string.ascii_lowercase]), k=r.randint(16, 40)))
    names = ("password", "passwd", "pwd", "passphrase"), ("secret", "token", "key", "api_key", "apikey")
    plain = lambda: "".join(r.choices(syllables, k=r.randint(3, 6)))
    cut = lambda x, sizes: [y for k, n in enumerate(sizes) if (y := x[sum(sizes[:k]) : sum(sizes[:k]) + n])]
    fours = lambda x: cut(x, [4] * 9)

    def grouped_card(valid: bool) -> list[str]:
        x = card(valid)
        return cut(x, [4, 6, 5]) if len(x) == 15 else fours(x)

    def grouped_iban() -> list[str]:
        return fours(r.choice(["DE", "FR", "GB", "ES", "NL"]) + digits(2) + r.choice(["", "", "".join(r.choices(string.ascii_uppercase, k=4))]) + digits(r.randint(14, 20)))

    def common() -> str:
        """A word as it may stand in any text."""
        x = word()
        return r.choice([x] * 12 + [x.capitalize()] * 3 + [x.upper(), f"{x.strip('.,')}-{plain()}", f"{plain()}_{plain()}", f"({x})", f"{plain()}/{plain()}", f"{plain()}.{plain()}", f"{x.strip('.,').capitalize()}{plain().capitalize()}", f"https://{host()}/{plain()}", f"www.{host()}", "-", "&", x + noise(), "=", "日本語", "über", "l'" + x])

    decoys = (
        lambda: " ".join(grouped_card(False)), lambda: f"{r.choice(r.choice(names))} {word()}", lambda: f"{r.choice(r.choice(names))} {plain()}", lambda: f"{r.choice(names[1])}{r.choice([':', '='])} {plain()}",
        lambda: f"= https://{host()}/{plain()}", lambda: f"{plain()} = {plain()}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(1, 40)}.", lambda: f"{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}", lambda: str(r.randint(1, 2100)),
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 23)}:{r.randint(0, 59):02}", lambda: f"${r.randint(1, 999)}.{digits(2)}", lambda: f"{r.randint(1, 100)}%",
        lambda: f"#{digits(r.randint(2, 7))}", lambda: digits(r.randint(5, 12)), lambda: f"{r.randint(300, 999)}.{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}", lambda: f"mp{r.randint(3, 4)}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: f"@{word().strip('.,')}", lambda: f"{r.randint(1, 99)}/{r.randint(1, 99)}", lambda: f"{r.randint(1, 400)}-{r.randint(1, 400)}", lambda: card(False), lambda: card(False), lambda: "#" + hexes(6), lambda: f"h{digits(3)}", lambda: f"https://{host()}/{plain()}/{digits(r.randint(1, 8))}", lambda: f"{plain()}_{digits(r.choice([2, 4]))}.{r.choice(['pdf', 'txt', 'py', 'csv'])}", lambda: f"{plain()}{digits(r.randint(1, 4))}", lambda: f"{digits(1)}{r.choice(['st', 'nd', 'th', 'x', 'km', 'GB', 'kg'])}", lambda: f"{r.randint(1, 9)}e{digits(1)}", lambda: f"{plain()}-{digits(r.randint(1, 3))}", lambda: f"{r.choice('ABCDEFG')}{digits(r.randint(1, 4))}", lambda: f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", lambda: " ".join(digits(r.randint(1, 4)) for _ in range(r.randint(2, 5))), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"@{plain()}{digits(r.randint(0, 2))}", lambda: f"{plain()}@", lambda: f"{plain().upper()}-{digits(r.randint(2, 4))}", lambda: f"{r.randint(1, 9)},{digits(3)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
    )
    spoken = {"EMAIL": ["email", "mail", "write", "contact"], "PHONE": ["call", "phone", "tel", "at"], "IP": ["host", "from", "server"], "CARD": ["card", "visa", "paid"], "SECRET": ["token", "key", "secret", "TOKEN", "password", "api_key"], "SSN": ["ssn", "SSN"], "IBAN": ["iban", "IBAN", "account"]}
    out = []
    for _ in range(count):
        row = [(common(), "O") for _ in range(r.randint(0, 4))]
        for _ in range(r.choice([1, 1, 1, 2])):
            after = noise()
            if r.random() < 0.5:
                row.append((r.choice(decoys)() + after, "O"))
            else:
                kind = r.choice([*KINDS, "CARD", "SECRET", "IP", "PHONE", "EMAIL"])
                if r.random() < 0.4 or kind in ("SSN", "IBAN"):
                    row.append((r.choice(spoken[kind]), "O"))
                parts = {"EMAIL": lambda: [email()], "PHONE": phone, "IP": lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))], "CARD": lambda: r.choice([[card(True)], [card(True)], grouped_card(True), ["-".join(grouped_card(True))]]), "SECRET": lambda: [secret()], "SSN": lambda: [f"{digits(3)}-{digits(2)}-{digits(4)}"], "IBAN": lambda: r.choice([[r.choice(["DE", "FR", "GB", "ES"]) + digits(2) + digits(r.randint(14, 20))], grouped_iban()])}[kind]()
                if kind == "SECRET" and r.random() < 0.45:
                    mark = r.choice([":", "=", ""])
                    row.append((r.choice(names[bool(r.random() < 0.5)]) + mark, "O"))
                    parts = [plain() if mark and row[-1][0][:2] in ("pa", "pw") and r.random() < 0.5 else letters()]
                parts[-1] += after
                row += [(p, f"{'I' if i else 'B'}-{kind}") for i, p in enumerate(parts)]
            row += [(common(), "O") for _ in range(r.choice([0, 1, 1, 2, 3]))]
        out.append(row)
    return out


def labelled_table(spark: SparkSession, seed: int = 7, count: int = 2600) -> DataFrame:
    """(sentence, position, token, label): the small labelled table, the same for the same seed."""
    return spark.createDataFrame([(s, i, t, y) for s, row in enumerate(_written(seed, count)) for i, (t, y) in enumerate(row)], "sentence int, position int, token string, label string")


def chain_features(text: str) -> list[list[str]]:
    """Names of all features of each token of a text."""
    tokens = _TOKEN.findall(text)
    each = [features(t) for t in tokens]
    kinds = [_group_kind(_core(t)) if len(t) < 16 else 0 for t in tokens]
    parts = [""] * len(tokens)
    i = 0
    while i < len(tokens):
        end = i
        while end < len(tokens) and kinds[end]:
            end += 1
        parts[i:end] = groups_of(tokens[i:end])
        i = max(end, i + 1)
    out = []
    for i, (own, _, _, _) in enumerate(each):
        names = own + (each[i - 1][1] if i else []) + (each[i - 2][2] if i > 1 else []) + (each[i + 1][3] if i + 1 < len(each) else [])
        out.append(names + ([f"g={parts[i]}"] if parts[i] else []))
    return out


def train(rows: list[tuple[int, int, str, str]], steps: int = 100, rate: float = 0.15, decay: float = 2e-3, least: int = 2, least_words: int = 8) -> Model:
    """Maximum penalised likelihood by Adam over whole sentences of labelled (sentence, position, token, label) rows; features
    that occur fewer than ``least`` times, and words that do so fewer than ``least_words``, are left out."""
    sentences: dict[int, list] = defaultdict(list)
    for s, i, t, y in sorted(rows):
        sentences[s].append((t, LABELS.index(y)))
    chains: list[tuple[list, list[int]]] = []
    for row in sentences.values():
        text, labels = "", {}
        for t, y in row:
            labels[len(text)] = y
            text += f"{t} "
        starts = [m.start() for m in _TOKEN.finditer(text)]
        if starts:
            chains.append((chain_features(text), [labels.get(x, 0) for x in starts]))
    often: dict[str, int] = defaultdict(int)
    for c, _ in chains:
        for f in (f for fs in c for f in fs):
            often[f] += 1
    names = {f: i for i, f in enumerate(f for f, n in often.items() if n >= (least_words if f.startswith(("pw=", "p:", "2=")) else least))}
    groups = defaultdict(list)
    for c, y in chains:
        groups[len(c)].append((c, y))
    packs = []
    for length, members in groups.items():
        found = [[[names[f] for f in fs if f in names] for fs in c] for c, _ in members]
        width = max(len(fs) for c in found for fs in c)
        ids = np.full((len(members), length, width), len(names))
        for i, c in enumerate(found):
            for t, fs in enumerate(c):
                ids[i, t, : len(fs)] = fs
        flat = ids.reshape(-1)
        order = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        packs.append((ids, np.array([y for _, y in members]), order // width, heads, flat[order][heads]))
    n_labels, total = len(LABELS), len(chains)
    w = np.zeros((len(names) + 1) * n_labels + n_labels * n_labels, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    cut = (len(names) + 1) * n_labels
    soft = lambda x, axis: (lambda top: np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis)))(x.max(axis=axis, keepdims=True))
    for step in range(1, steps + 1):
        emit, move = w[:cut].reshape(-1, n_labels), w[cut:].reshape(n_labels, n_labels)
        emit[-1] = 0
        g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)
        for ids, gold, token, heads, feature in packs:
            e = emit[ids].sum(axis=2)
            n, length, _ = e.shape
            alpha, beta = np.empty_like(e), np.empty_like(e)
            alpha[:, 0] = e[:, 0] + move[0]
            for t in range(1, length):
                alpha[:, t] = soft(alpha[:, t - 1][:, :, None] + move[None], 1) + e[:, t]
            beta[:, -1] = move[:, 0]
            for t in range(length - 2, -1, -1):
                beta[:, t] = soft(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None], 2)
            z = soft(alpha[:, -1] + move[:, 0], 1)
            near = -np.exp(alpha + beta - z[:, None, None])
            g_move[:, 0] += near[:, -1].sum(axis=0)
            g_move[0] += near[:, 0].sum(axis=0)
            near[np.arange(n)[:, None], np.arange(length)[None], gold] += 1
            for t in range(1, length):
                pair = np.exp(alpha[:, t - 1][:, :, None] + move[None] + (e[:, t] + beta[:, t])[:, None] - z[:, None, None])
                g_move -= pair.sum(axis=0)
                np.add.at(g_move, (gold[:, t - 1], gold[:, t]), 1)
            np.add.at(g_move[0], gold[:, 0], 1)
            np.add.at(g_move[:, 0], gold[:, -1], 1)
            g_emit[feature] += np.add.reduceat(near.reshape(-1, n_labels)[token], heads, axis=0)
        g = np.concatenate([g_emit.reshape(-1), g_move.reshape(-1)]) / total - decay * w / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(names, w[:cut].reshape(-1, n_labels)[:-1].copy(), w[cut:].reshape(n_labels, n_labels).copy())


@lru_cache(maxsize=4)
def _trained(rows: tuple) -> Model:
    return train(list(rows))


def trained(spark: SparkSession) -> Model:
    """The model of the labelled table; one driver trains it once."""
    return _trained(tuple(tuple(r) for r in labelled_table(spark).collect()))


def _finder(model: Model):
    @F.arrow_udf(f"struct<text: string, spans: {SPANS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for texts in batches:
            plain = texts.to_pylist()
            found = find(model, plain)
            changed = [redact(t, s) if s else None for t, s in zip(plain, found, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(changed, pa.string()), pa.array([[dict(zip(("start", "end", "kind"), x, strict=True)) for x in s] for s in found], kind)], ["text", "spans"])

    return run


def private_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_spans, spans, text) of the documents that hold private data; ``text`` has each span replaced by its kind."""
    small_batches(docs.sparkSession)
    model = model or trained(docs.sparkSession)
    found = docs.select("doc_id", _finder(model)("text").alias("found")).where(F.size("found.spans") > 0)
    return found.select("doc_id", F.size("found.spans").cast("long").alias("n_spans"), "found.spans", "found.text")


def redacted(docs: DataFrame, model: Model | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with private data replaced by its kind; ``length_col``, where there is one, follows the text."""
    small_batches(docs.sparkSession)
    model = model or trained(docs.sparkSession)
    into = "found"
    while into in docs.columns:
        into += "_"
    changed = F.col(f"{into}.text")
    found = docs.withColumn(into, _finder(model)(F.col(text_col)))
    if length_col in docs.columns:
        found = found.withColumn(length_col, F.when(changed.isNotNull(), F.length(changed)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return found.withColumn(text_col, F.coalesce(changed, F.col(text_col))).drop(into)
