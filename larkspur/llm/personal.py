"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns' matches are the base. Around them each document gets a graph over its tokens with a digit or an at sign: tokens
that follow one another are joined, and so is each token with the last one before it that is equal or similar (the same last
seven digits, the same mailbox). Tokens of base spans are observed. All others carry potentials of their form, of their
neighbours' labels and of the labels of similar tokens, however far away, and loopy message passing settles each
document's labels together. Free tokens that end up as personal data with a high belief become added spans.

All other tokens are observed as plain text, which cuts the chains there, so work follows the tokens that could be personal
data. Equal tokens form a chain, not all pairs, so the edges are at most twice the tokens.

The field is fitted to the base labels of all documents by pseudo-likelihood. What it needs is counts of (form, label, labels
of neighbours); forms are a few bounded buckets, so those counts are a small table whatever the input's size, and the weights are
the same at every partitioning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larkspur.llm.arrays import release

# The base patterns, in the order of kinds, and their limits.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)
MOST_PART = 255

BLANKS = " \t\n\v\f\r"
#: A token with a digit or an at sign, from its start on, read once.
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
NOT_DIGIT = re.compile(r"[^0-9]+")
LETTER = re.compile(r"[^\W\d_]")
OPENING, CLOSING = "<[{\"'`,;:.!?|=", ">]})\"'`,;:.!?|="
SIMILAR_DIGITS = 7
NAME_CHARS = 5

LABELS = 1 + len(KINDS)
NONE = LABELS  # the label of a neighbour that is not there
#: Buckets of a token's form, each with its number of values.
FORM = {"at": 2, "digits": 9, "plus": 2, "paren": 2, "dash": 2, "dots": 4, "letters": 2, "valid": 2}
FEATURES = sum(FORM.values())
DIGIT_EDGES = (1, 2, 4, 7, 8, 10, 16, 20)

MESSAGE_ROUNDS = 20
DAMPING = 0.5
LEAST_BELIEF = 0.9
FIT_STEPS = 400
PENALTY = 1e-4
#: Pairs of similar tokens that count as agreeing before any is seen.
PRIOR_AGREE = 400
FAR = -40.0

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: all characters before an at sign that may be in a mailbox, as far as the last match allows."""
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        start = done + len(head.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def parts_fit(address: str) -> bool:
    parts = [p.lstrip("0") for p in address.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= MOST_PART for p in parts)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the pattern matches that hold, by kind and start; each pattern reads the text once."""
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if parts_fit(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = NOT_DIGIT.sub("", m[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(NOT_DIGIT.sub("", m[0])) <= PHONE_DIGITS[1]:
            found.append((3, *m.span()))
    return found


def form(token: str) -> int:
    """The buckets of a token's form as one number."""
    digits = NOT_DIGIT.sub("", token)
    dots = token.count(".")
    valid = (CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)) or (
        dots == 3 and IP.fullmatch(token) is not None and parts_fit(token)
    )
    values = (
        "@" in token, sum(len(digits) >= e for e in DIGIT_EDGES), "+" in token, "(" in token or ")" in token, "-" in token,
        min(dots, 3), LETTER.search(token) is not None, valid,
    )
    code = 0
    for value, size in zip(values, FORM.values()):
        code = code * size + int(value)
    return code


def form_vectors(codes: np.ndarray) -> np.ndarray:
    """One indicator per bucket value of each form."""
    out, at = np.zeros((len(codes), FEATURES)), FEATURES
    rest = codes.copy()
    for size in reversed(FORM.values()):
        at -= size
        out[np.arange(len(codes)), at + rest % size] = 1
        rest //= size
    return out


def likeness(token: str) -> str:
    """Tokens of one likeness are equal or similar; empty for tokens too plain to tell."""
    digits = NOT_DIGIT.sub("", token)
    if "@" in token:
        return token.split("@", 1)[0].lower()
    if len(digits) >= SIMILAR_DIGITS:
        return digits[-SIMILAR_DIGITS:]
    return token.lower() if len(token) >= NAME_CHARS and LETTER.search(token) else ""


class Graph:
    """Tokens of one document with a digit or an at sign, their observed labels and edges."""

    def __init__(self, text: str):
        self.base = base_spans(text)
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.codes: list[int] = []
        self.labels: list[int] = []  # 0: plain by the patterns, free for the field
        self.chain: list[int] = []  # the node before, if it is the token before
        self.skip: list[int] = []  # the last similar node before
        self.group: list[int] = []  # the first node of those that are similar
        spans, at = sorted((a, b, kind) for kind, a, b in self.base), 0
        seen: dict[str, int] = {}
        for m in TOKEN.finditer(text):
            raw = m[0]
            token = raw.lstrip(OPENING).rstrip(CLOSING if "(" not in raw else CLOSING.replace(")", ""))
            start = m.start() + len(raw) - len(raw.lstrip(OPENING))
            if not token:
                start, token = m.start(), raw
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            over, k = 0, at
            while not over and k < len(spans) and spans[k][0] < m.end():
                over = 1 + spans[k][2] if spans[k][1] > m.start() else 0
                k += 1
            node = len(self.starts)
            adjacent = node > 0 and not text[self.ends[-1] : m.start()].strip(BLANKS + OPENING + CLOSING)
            key = likeness(token)
            self.chain.append(node - 1 if adjacent else -1)
            self.skip.append(seen.get(key, -1))
            self.group.append(self.group[seen[key]] if key in seen else node)
            if key:
                seen[key] = node
            self.starts.append(start)
            self.ends.append(start + len(token))
            self.codes.append(form(token))
            self.labels.append(over)


def neighbours(graph: Graph) -> Iterator[tuple[int, int, int, int, int]]:
    """(form, label, label before, label behind, label of a similar token) of each labelled node, for fitting.

    The patterns do not tell the label of a free token that is similar to one in a base span, only that they do not
    match it. Such tokens are left out, and do not count as neighbours.
    """
    n = len(graph.starts)
    matched = {graph.group[k] for k in range(n) if graph.labels[k]}
    known = [label if label or graph.group[k] not in matched else NONE for k, label in enumerate(graph.labels)]
    behind, later = [NONE] * n, [NONE] * n
    for k in range(n):
        if graph.chain[k] >= 0:
            behind[graph.chain[k]] = known[k]
        if graph.skip[k] >= 0:
            later[graph.skip[k]] = known[k]
    for k in range(n):
        if known[k] != NONE:
            before = known[graph.chain[k]] if graph.chain[k] >= 0 else NONE
            yield graph.codes[k], known[k], before, behind[k], known[graph.skip[k]] if graph.skip[k] >= 0 else later[k]


COUNTS = ("form", "label", "before", "behind", "similar")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: how often each combination of COUNTS occurs in a task."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(neighbours(Graph(text.as_py() or "")))
        release()
    columns = list(zip(*[(*k, n) for k, n in seen.items()])) if seen else [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*COUNTS, "n"])


class Weights:
    """Potentials in logarithms: of forms (features, labels), of followers (before, behind), and of similar tokens."""

    def __init__(self, of_form: np.ndarray, of_chain: np.ndarray, of_skip: np.ndarray):
        self.of_form, self.of_chain, self.of_skip = of_form, of_chain, of_skip


def climb(inputs: list[np.ndarray], fixed: np.ndarray, goal: np.ndarray, share: np.ndarray, scores, slopes) -> list[np.ndarray]:
    """Weights of the highest penalised likelihood, by accelerated gradient steps from zero."""
    w = [np.zeros_like(x) for x in inputs]
    ahead = [x.copy() for x in w]
    for step in range(FIT_STEPS if len(goal) else 0):
        logits = fixed + scores(ahead)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        off = share * (p / p.sum(axis=1, keepdims=True) - goal)
        new = [x - (s + PENALTY * x) for x, s in zip(ahead, slopes(off))]
        ahead = [x + step / (step + 3) * (x - old) for x, old in zip(new, w)]
        w = new
    return w


def fit(counts: np.ndarray) -> Weights:
    """The weights from the columns COUNTS and their number, piece by piece, each fitted to what the one before leaves open.

    The forms' weights come first. With them fixed, those of followers by pseudo-likelihood. Potentials that only repeat what a
    token's form says are thus small, so that tokens without evidence don't talk each other into a label. Similar tokens favour
    one label, whichever it is, by the odds at which known pairs agree. Without rows all is zero but the prior agreement.
    """
    counts = counts[np.lexsort(counts.T[::-1])]
    codes, label, before, behind, similar, n = counts.T
    forms, goal, share = form_vectors(codes), np.eye(LABELS)[label], (n / max(n.sum(), 1))[:, None]
    left, right = (np.eye(LABELS + 1)[x][:, :LABELS] for x in (before, behind))
    zero = np.zeros((len(counts), LABELS))
    (of_form,) = climb([np.zeros((FEATURES, LABELS))], zero, goal, share, lambda w: forms @ w[0], lambda off: [forms.T @ off])
    (of_chain,) = climb(
        [np.zeros((LABELS, LABELS))], forms @ of_form, goal, share,
        lambda w: left @ w[0] + right @ w[0].T, lambda off: [left.T @ off + off.T @ right],
    )
    pair = similar != NONE
    agree, differ = n[pair & (similar == label)].sum(), n[pair & (similar != label)].sum()
    return Weights(of_form, of_chain, np.log((agree + PRIOR_AGREE) / (differ + 1)) * np.eye(LABELS))


def train(docs: DataFrame, text: str = "text") -> Weights:
    """The field's weights from the base labels of all documents.

    The table collected has a row per combination of form and labels that occurs: a few hundred usually, and at most 2,304
    forms x 5 labels x 6**3 labels of neighbours.
    """
    kinds = ", ".join(f"{c} long" for c in (*COUNTS, "n"))
    seen = docs.select(F.col(text).cast("string")).mapInArrow(counted, kinds).groupBy(*COUNTS).agg(F.sum("n").alias("n")).collect()
    return fit(np.array([list(r) for r in seen], np.int64).reshape(-1, 6))


def beliefs(codes: np.ndarray, labels: np.ndarray, edges: np.ndarray, is_skip: np.ndarray, w: Weights) -> np.ndarray:
    """Label probabilities of each node after loopy sum-product message passing; labels above 0 are observed.

    ``edges`` holds (earlier, later) nodes. A fixed number of damped rounds, so that a document's result does not depend on the
    documents it is handled with; exact on trees once messages have crossed them.
    """
    own = form_vectors(codes) @ w.of_form
    own -= own.max(axis=1, keepdims=True)
    seen = labels > 0
    own[seen] = FAR
    own[seen, labels[seen]] = 0
    potential = np.exp(np.stack([w.of_chain, w.of_chain.T, w.of_skip, w.of_skip.T]))
    kind = np.concatenate([2 * is_skip, 2 * is_skip + 1]).astype(np.int64)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.full((len(source), LABELS), -np.log(LABELS))
    for _ in range(MESSAGE_ROUNDS if len(edges) else 0):
        total = own.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        made = np.log(sum(out[:, k : k + 1] * potential[kind, k] for k in range(LABELS)))
        made -= np.log(np.exp(made).sum(axis=1, keepdims=True))
        message = DAMPING * message + (1 - DAMPING) * made
    np.add.at(own, target, message)
    own = np.exp(own - own.max(axis=1, keepdims=True))
    return own / own.sum(axis=1, keepdims=True)


def added_spans(graphs: list[Graph], w: Weights) -> list[list[Span]]:
    """Per document the spans of free tokens that are personal data by the field; tokens in a row with one label are one span."""
    sizes = np.array([len(g.starts) for g in graphs], np.int64)
    base = np.cumsum(sizes) - sizes
    codes, labels = (np.array([x for g in graphs for x in part(g)], np.int64) for part in (lambda g: g.codes, lambda g: g.labels))
    chain, skip = [], []
    for lo, g in zip(base.tolist(), graphs):
        chain += [(lo + c, lo + k) for k, c in enumerate(g.chain) if c >= 0]
        skip += [(lo + s, lo + k) for k, s in enumerate(g.skip) if s >= 0]
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    p = beliefs(codes, labels, edges, np.arange(len(edges)) >= len(chain), w).round(6)
    chosen = np.where((p.max(axis=1, initial=0) >= LEAST_BELIEF) & (labels == 0), p.argmax(axis=1) if len(p) else 0, 0).tolist()
    found = []
    for lo, g in zip(base.tolist(), graphs):
        own: list[Span] = []
        last = -1
        for k, label in enumerate(chosen[lo : lo + len(g.starts)]):
            if label and last >= 0 and g.chain[k] == last and own[-1][0] == label - 1:
                own[-1] = (label - 1, own[-1][1], g.ends[k])
            elif label:
                own.append((label - 1, g.starts[k], g.ends[k]))
            last = k if label else -1
        found.append(own)
    return found


SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
GROUP_ROWS = 500


def finder(w: Weights, text: str, kept: list[str]):
    """For mapInArrow: the kept columns with the spans of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, GROUP_ROWS):
                batch = whole.slice(lo, GROUP_ROWS)
                graphs = [Graph(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))]
                made = []
                for g, more in zip(graphs, added_spans(graphs, w)):
                    spans = sorted([(*s, True) for s in g.base] + [(*s, False) for s in more])
                    made.append([{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans])
                own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(made, SPAN)], names=[*kept, "_spans"])
            release()

    return rows


def find_personal(
    docs: DataFrame, weights: Weights | None = None, text: str = "text", into: str = "personal", keep: list[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` with an array ``into`` of spans (kind, start, end, base), by kind, then start.

    Offsets are code points of the whole text, ends exclusive. ``base`` tells pattern matches from spans that the field adds;
    added ones never overlap base ones. Without ``weights`` the field is fitted to these documents first, in one more pass.

    Null and empty texts have no spans. Repeated rows have equal spans. A table without matches fits a field that adds
    nothing; an empty table gives no rows. A very long text is read whole, once per pattern, and its graph grows with its tokens
    that hold digits or at signs. A column named ``into`` is replaced; ``keep`` names the other columns, all by default.
    """
    weights = train(docs, text) if weights is None else weights
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    fields = [f for f in docs.schema.fields if f.name in kept]
    made = StructType([*fields, StructField("_spans", StructType.fromDDL(f"x {SPANS}")[0].dataType)])
    read = docs.select(*dict.fromkeys([*[f.name for f in fields], text]))
    return read.mapInArrow(finder(weights, text, [f.name for f in fields]), made).withColumnRenamed("_spans", into)
