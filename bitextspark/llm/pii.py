"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what they miss.

The CRF is trained on a small labelled table of sentences and decodes windows of words around digits,
`@` and bracketed "at" (a number or an address without any of them cannot be found, so the
rest of a text is never tokenised). Windows of a batch are decoded together by Viterbi in
numpy. CRF spans must pass the same plausibility tests as the patterns (digit counts, Luhn,
parts up to 255) and may not overlap a pattern's span of any kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextspark.llm.words import blocks, row_sums, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Labelled rows used for training at most.
MAX_LABELLED = 2000

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits: from the run's first digit it matches as well.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain in linear time: every match surrounds an `@`, and
    begins where the run of local characters before it does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
            free = found.end()
        # Local characters before a failed @ are not looked at again.
        free = max(free, at + 1)
        at = text.find("@", free)
    return out


def _small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _plausible(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "ip":
        return _IP.fullmatch(text) is not None and _small_parts(text)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; failing matches are dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _plausible(kind, m.group())]
    return out


# --- the CRF -------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_](?:[\w.@%+-]*[^\W_])?|[^\w\s]|_")
_ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")
MARGIN = 48
#: Words whose presence next to a number tells what it is.
CUES = frozenset("at dot call tel phone fax mail mobile card visa ip host address version v license page year no order token".split())
FEATURES = 9


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


_RUN_CLASSES = ((4, ""), (7, "m"), (11, "n"), (15, "o"), (19, "p"))
_PARTS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^\W\d_]+|.", re.DOTALL)


def shapes(word: str) -> tuple[str, str]:
    """A short shape (runs as one letter) and a long one (digit runs with their length class)."""
    short, long = [], []
    for part in _PARTS.findall(word[:200]):
        if part[0].isdigit() and part.isascii():
            size = len(part)
            long.append(str(size) if size <= 4 else next((c for most, c in _RUN_CLASSES if size <= most), "q"))
            short.append("9")
        elif part.isalpha():
            kind = "A" if part.isupper() else "a"
            short.append(kind)
            long.append(kind)
        else:
            short.append(part)
            long.append(part)
    return "".join(short)[:24], "".join(long)[:24]


def features(words: list[str]) -> list[list[str]]:
    """`FEATURES` strings for each word: its shapes and those of its neighbours."""
    every = [shapes(w) for w in words]
    edge = ("^", "^")
    out = []
    for i, (short, long) in enumerate(every):
        before = every[i - 1] if i else edge
        after = every[i + 1] if i + 1 < len(every) else edge
        after2 = every[i + 2] if i + 2 < len(every) else edge
        cue = words[i].lower() if words[i].lower() in CUES else ""
        last = words[i - 1].lower() if i and words[i - 1].lower() in CUES else ""
        out.append(
            ["bias", f"s={short}", f"l={long}", f"p={before[1]}", f"n={after[1]}", f"pl={before[1]}|{long}", f"ln={long}|{after[1]}|{after2[1]}", f"c={cue}", f"cp={last}"]
        )
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Crf:
    """Weights of a trained chain: feature strings, emissions (features x tags; row 0 is for
    unknown features) and transitions."""

    index: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray

    def encode(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([[self.index.get(f, 0) for f in row] for row in rows], dtype=np.int32).reshape(-1, FEATURES)

    def scores(self, coded: np.ndarray) -> np.ndarray:
        return self.emission[coded].sum(axis=-2)

    def viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best tags (batch x time) of padded score rows (batch x time x tags)."""
        batch, time, tags = scores.shape
        best = scores[:, 0]
        back = np.zeros((batch, time, tags), dtype=np.int8)
        for t in range(1, time):
            step = best[:, :, None] + self.transition
            back[:, t] = step.argmax(axis=1)
            live = (t < sizes)[:, None]
            best = np.where(live, step.max(axis=1) + scores[:, t], best)
        out = np.zeros((batch, time), dtype=np.int8)
        tag = best.argmax(axis=1)
        every = np.arange(batch)
        for t in range(time - 1, -1, -1):
            out[:, t] = np.where(t < sizes, tag, 0)
            if t:
                tag = np.where(t < sizes, back[every, t, tag], tag)
        return out


def _allowed() -> np.ndarray:
    """An inside tag follows a tag of its kind only."""
    ok = np.zeros((len(TAGS), len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag.startswith("I-"):
            for i, other in enumerate(TAGS):
                if other[2:] != tag[2:]:
                    ok[i, j] = -1e4
    return ok


def fit(rows: list[tuple[str, list[Span]]], rounds: int = 50, penalty: float = 0.02, rate: float = 0.2) -> Crf:
    """Maximum likelihood with an L2 penalty by Adam on all rows at once; deterministic."""
    if not rows:
        raise ValueError("the labelled table is empty")
    coded_strings, tags = [], []
    for text, spans in rows:
        at = tokens(text)
        coded_strings.append(features([text[a:b] for a, b in at]))
        row = []
        for a, b in at:
            tag = "O"
            for kind, s, e in spans:
                if s <= a and b <= e:
                    tag = ("B-" if not any(s <= x and y <= a for x, y in at if y <= a and x >= s) else "I-") + kind
            row.append(TAGS.index(tag))
        tags.append(row)
    names = sorted({f for row in coded_strings for fs in row for f in fs})
    index = {f: i + 1 for i, f in enumerate(names)}
    count, time, n_tags = len(rows), max(1, *map(len, tags)), len(TAGS)
    coded = np.zeros((count, time, FEATURES), dtype=np.int32)
    gold = np.zeros((count, time), dtype=np.int64)
    sizes = np.array([len(t) for t in tags])
    for i, (row, tag) in enumerate(zip(coded_strings, tags)):
        if row:
            coded[i, : len(row)] = [[index[f] for f in fs] for fs in row]
            gold[i, : len(tag)] = tag
    live = np.arange(time)[None, :] < sizes[:, None]
    fixed = _allowed()
    params = [np.zeros((len(names) + 1, n_tags)), np.zeros((n_tags, n_tags))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    truth = np.zeros((count, time, n_tags))
    np.put_along_axis(truth, gold[:, :, None], 1.0, axis=2)
    truth *= live[:, :, None]
    live_codes = coded[live].reshape(-1)
    both = live[:, 1:] & live[:, :-1]
    true_steps = np.zeros((n_tags, n_tags))
    np.add.at(true_steps, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        emission, transition = params[0], params[1] + fixed
        scores = emission[coded].sum(axis=2)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, time):
            new = _log_sum(alpha[:, t - 1][:, :, None] + transition, 1) + scores[:, t]
            alpha[:, t] = np.where(live[:, t][:, None], new, alpha[:, t - 1])
        for t in range(time - 2, -1, -1):
            new = _log_sum(transition + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1][:, None], new, beta[:, t + 1])
        norm = _log_sum(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - norm[:, None, None]) * live[:, :, None]
        error = (truth - marginal)[live]
        gradient = np.stack(
            [np.bincount(live_codes, weights=np.repeat(error[:, k], FEATURES), minlength=len(emission)) for k in range(n_tags)], axis=1
        )
        steps = np.zeros_like(true_steps)
        for t in range(1, time):
            joint = alpha[:, t - 1][:, :, None] + transition + (scores[:, t] + beta[:, t])[:, None, :] - norm[:, None, None]
            steps += np.exp(joint[live[:, t]]).sum(axis=0)
        gradient[0] = 0
        for p, m, g in zip(params, moments, (gradient, true_steps - steps)):
            g = g - penalty * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    params[0][0] = 0
    return Crf(index, params[0].astype(np.float32), (params[1] + fixed).astype(np.float32))


# --- the labelled table --------------------------------------------------------------

LABELLED = "text string, spans array<struct<kind: string, start: int, end: int>>"


def _example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """One labelled sentence by rule: invented words around one or two numbers or addresses."""
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    pick = lambda options: options[int(rng.integers(len(options)))]

    def word() -> str:
        w = letters(int(rng.integers(1, 11)))
        return pick([w, w, w, w.capitalize(), w + ",", w + ".", w.upper()])

    def email() -> str:
        local = pick([letters(6), f"{letters(4)}.{letters(5)}", f"{letters(3)}{digits(2)}", f"{letters(4)}.{digits(2)}"])
        site = f"{letters(5)}{pick(['', digits(1)])}"
        plain = f"{local}@{site}.{pick(['example.com', 'org', 'co.uk', 'net'])}"
        return pick([plain, plain, f"{local} [at] {site} [dot] org", f"{local} (at) {site} (dot) com"])

    def card() -> str:
        while True:
            d = digits(16)
            if luhn(d):
                break
        four = [d[i : i + 4] for i in range(0, 16, 4)]
        return pick([d, " ".join(four), "-".join(four), ".".join(four)])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(
            [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {digits(7)}", f"00 49 {a} {digits(7)}", f"+{digits(2)}-{a}-{b}-{c}", f"{a}.{b}.{c}"]
        )

    def ip() -> str:
        return ".".join(str(v) for v in rng.integers(0, 256, 4))

    def other() -> str:
        return pick(
            [
                str(rng.integers(1900, 2100)), f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.",
                f"version {rng.integers(1, 9)}.", f"{rng.integers(1, 99)},{digits(3)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}",
                f"{rng.integers(0, 24)}:{digits(2)}", f"{rng.integers(1, 400)}", f"{digits(5)}", f"{digits(8)}", f"{rng.integers(1, 99)}.{digits(2)}", f"v{rng.integers(1, 9)}.{digits(1)}.{digits(1)}",
                f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', f"{letters(2).upper()}-{digits(4)}", f"@{letters(6)}", f"no. {digits(6)}", f"{digits(12)}", f"{digits(3)} {letters(5)} {digits(3)}",
            ]
        )

    text, spans = "", []
    for _ in range(int(rng.integers(1, 3))):
        text += " ".join(word() for _ in range(int(rng.integers(1, 6)))) + " "
        kind = pick([*KINDS, "other", "other", "other"])
        value = {"email": email, "ip": ip, "card": card, "phone": phone, "other": other}[kind]()
        if kind != "other":
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + pick(["", "", ".", ",", "!!", "###", "$$$"]) + " "
    return text + " ".join(word() for _ in range(int(rng.integers(0, 5)))), spans


def labelled_table(spark: SparkSession, rows: int = 400, seed: int = 7) -> DataFrame:
    """A small labelled table made by rule (`LABELLED`)."""
    rng = np.random.default_rng(seed)
    made = [_example(rng) for _ in range(rows)]
    return spark.createDataFrame([(t, [tuple(s) for s in spans]) for t, spans in made], LABELLED)


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> Crf:
    """Fit on at most `max_rows` rows of a labelled table, in the order of their text.

    Rows with a null text are skipped; null spans count as none."""
    rows = labelled.where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    return fit([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] or []]) for r in rows])


# --- the operator --------------------------------------------------------------------


def _windows(text: str) -> list[list[tuple[int, int]]]:
    """Token spans of the stretches around digits, @ and bracketed at."""
    out: list[list[tuple[int, int]]] = []
    low = high = -1
    for m in _ANCHOR.finditer(text):
        if high >= 0 and m.start() - MARGIN <= high:
            high = m.end() + MARGIN
            continue
        if high >= 0:
            out.append(_whole_tokens(text, low, high))
        low, high = max(0, m.start() - MARGIN), m.end() + MARGIN
    if high >= 0:
        out.append(_whole_tokens(text, low, high))
    return [w for w in out if w]


def _whole_tokens(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Tokens between the blanks nearest to the borders (inside the margin)."""
    if low > 0:
        blank = re.compile(r"\s").search(text, low, low + MARGIN)
        low = blank.end() if blank else low
    if high < len(text):
        cut = max(text.rfind(" ", high - MARGIN, high), text.rfind("\n", high - MARGIN, high))
        high = cut if cut > low else min(high, len(text))
    return tokens(text, low, min(high, len(text)))


def crf_spans(batch: list[str], crf: Crf) -> list[list[Span]]:
    """Plausible CRF spans of each text, in order."""
    places: list[tuple[int, list[tuple[int, int]]]] = [(i, w) for i, t in enumerate(batch) for w in _windows(t)]
    places.sort(key=lambda p: len(p[1]))
    out: list[list[Span]] = [[] for _ in batch]
    at = 0
    while at < len(places):
        upto, longest = at + 1, len(places[at][1])
        while upto < len(places) and len(places[upto][1]) <= longest + 8 and (upto - at) * len(places[upto][1]) < 20_000:
            upto += 1
        group = places[at:upto]
        sizes = np.array([len(w) for _, w in group])
        padded = np.zeros((len(group), int(sizes.max()), len(TAGS)), dtype=np.float32)
        for k, (i, w) in enumerate(group):
            padded[k, : len(w)] = crf.scores(crf.encode(features([batch[i][a:b] for a, b in w])))
        for (i, w), row in zip(group, crf.viterbi(padded, sizes)):
            out[i] += _tagged(batch[i], w, row)
        at = upto
    return out


def _tagged(text: str, at: list[tuple[int, int]], tags: np.ndarray) -> list[Span]:
    found: list[Span] = []
    current: list | None = None
    for (a, b), t in zip(at, tags.tolist()):
        tag = TAGS[t]
        if tag.startswith("I-") and current:
            current[2] = b
            continue
        if current:
            found.append(tuple(current))
        current = [tag[2:], a, b] if tag != "O" else None
    if current:
        found.append(tuple(current))
    return [s for s in found if _plausible(s[0], text[s[1] : s[2]])]


def all_spans(batch: list[str], crf: Crf | None) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text, both by kind as listed, then start."""
    base = [base_spans(t) for t in batch]
    extra = crf_spans(batch, crf) if crf else [[] for _ in batch]
    out = []
    for one, more in zip(base, extra):
        taken = sorted((a, b) for _, a, b in one)
        added = [s for s in more if not any(a < s[2] and s[1] < b for a, b in taken)] if more else []
        every = sorted(set(one) | set(added), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append((one, every))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(df: DataFrame, crf: Crf | None, text: str = "text", masked: str | None = None) -> DataFrame:
    """Append `base_spans` and `all_spans` (code points, end exclusive) and, if `masked` is
    given, a column of that name with every span replaced by `[KIND]`.

    Null texts have no spans and an empty masked text stays null. Repeated rows and other columns pass
    through; output names that the table has already raise at plan time.
    """
    added = [("base_spans", T.ArrayType(SPAN)), ("all_spans", T.ArrayType(SPAN))]
    if masked:
        added.append((masked, T.StringType()))
    clash = {name for name, _ in added} & set(df.columns)
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already; drop or rename them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for block in blocks(column):
                # Texts without digits, @ and a bracketed "at" have no spans.
                data = block.data
                sign = ((data >= 0x30) & (data <= 0x39)) | (data == 0x40) | (data == 0x5B) | (data == 0x28)
                some = np.flatnonzero(row_sums(sign, block.bounds))
                every = texts(block) if masked else None
                raw = data.tobytes()
                picked = [raw[block.bounds[i] : block.bounds[i + 1]].decode("utf-8", "replace") for i in some]
                base: list[list] = [[] for _ in range(block.rows)]
                full: list[list] = [[] for _ in range(block.rows)]
                for i, (one, both) in zip(some.tolist(), all_spans(picked, crf)):
                    base[i], full[i] = one, both
                rows = batch.slice(block.first, block.rows)
                columns = [*rows.columns, _spans(base), _spans(full)]
                if masked:
                    hidden = [_mask(t, s) for t, s in zip(every, full)]
                    nulls = column.slice(block.first, block.rows).is_null().to_pylist()
                    columns.append(pa.array([None if n else t for n, t in zip(nulls, hidden)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(n for n, _ in added)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in added)]))


def _spans(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], _ARROW_SPANS)


def _mask(text: str, spans: list[Span]) -> str:
    """Overlapping spans are replaced together, under the name of the first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
