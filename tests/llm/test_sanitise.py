"""Personal data against the definition's own patterns, and the disclosure statistics against plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from mistgrove.llm import sanitise
from mistgrove.llm.common import documents

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def terms(text):
    return [m for m in re.finditer(r"[^\W\d_][^\W_]*", text)]


def brute(rows):
    """Per row (key, counts of the base, digest, all spans)."""
    found, near, with_entity = [], [], defaultdict(set)
    holding = defaultdict(set)
    for row, (_, text) in enumerate(rows):
        text = text or ""
        for m in terms(text):
            holding[lower(m[0])].add(row)
        here = []
        for kind, pattern in BASE.items():
            matches = list(re.finditer(pattern, text))
            for i, m in enumerate(matches):
                if not holds(kind, m[0]):
                    continue
                here.append((kind, m.start(), m.end()))
                entity = (kind, re.sub("[^0-9]", "", m[0]) if kind in ("card", "phone") else lower(m[0]))
                before = text[matches[i - 1].end() if i else 0 : m.start()]
                after = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
                words = [lower(x[0]) for x in terms(before)][-8:] + [lower(x[0]) for x in terms(after)][:8]
                with_entity[entity].add(row)
                near += [(entity, w, row, " ".join(words)) for w in words]
        found.append(here)
    pairs, passages = defaultdict(set), defaultdict(set)
    for entity, word, row, passage in near:
        pairs[entity, word].add(row)
        passages[entity, word].add(passage)
    hidden = {}
    for (entity, word), held in pairs.items():
        if word not in holding:  # what a match left of a longer word
            continue
        told = math.log2(len(rows) * len(held) / (len(holding[word]) * len(with_entity[entity])))
        if len(passages[entity, word]) >= 2 and told >= 4 - 1e-9:
            hidden[word] = min(hidden.get(word, 99), math.log2(len(holding[word]) / len(held)))
    action = {w: "remove" if h <= 1 + 1e-9 else "generalise" for w, h in hidden.items() if h <= 3 + 1e-9}
    for (key, text), here in zip(rows, found, strict=True):
        listed = [f"{k}:{a}:{b}" for k, a, b in here]
        more = defaultdict(list)
        for m in terms(text or ""):
            if (kind := action.get(lower(m[0]))) and not any(a <= m.start() < b for _, a, b in here):
                more[kind].append(f"{kind}:{m.start()}:{m.end()}")
        counts = Counter(k for k, _, _ in here)
        yield (key, *[counts[k] for k in BASE], len(more["remove"]), len(more["generalise"]), hashlib.sha256(",".join(listed).encode()).hexdigest(),
               ",".join(listed + more["remove"] + more["generalise"]))


@pytest.fixture(scope="module")
def rows():
    made = random.Random(13)
    words = ["".join(made.choices(["la", "mo", "ti", "Ren", "sá", "po"], k=made.randint(1, 4))) for _ in range(300)]

    def prose(n):
        return " ".join(made.choices(words, k=n))

    texts = [prose(made.randint(0, 60)) for _ in range(300)]
    for i in range(8):  # a nickname that goes with one address, a street that mostly does
        texts.append(f"{prose(20)} Zorrobert of Quickstreet writes from zor.bert@mail{i % 2}.example.com {prose(9)}")
        texts.append(f"{prose(5)} near quickstreet {prose(5)}")
    texts.append("Zorrobert alone")
    texts += ["a@b@c.d", "a@b.c_x@d.e", "éx.y@z.de.", "1.2.3.4.5.6.7.8", "256.1.1.1 and 0255.01.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-99",
              "+49 30 1234567-", "++12 34 56 78 90", "+1", "1" * 6_000, "x" * 6_000, "a@" * 2_000, "1 " * 20_000, "." * 3_000 + "@a.b", "+1" + "(" * 30_000, "1.1.1." * 3_000,
              "東京 +81 3 1234 5678 🙂 a@b.co", None, None, "", " \n", "4111111111111111 " * 300]
    alphabet = "a1.@-+ ()45é"
    texts += ["".join(made.choices(alphabet, k=made.randint(1, 60))) for _ in range(300)]
    return [*enumerate(texts), (4, "4111111111111111"), (4, "4111111111111111"), (None, "x@y.z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], "doc_id long, text string, row long, kind string, start long, end long").repartition(3).cache()


@pytest.mark.parametrize("few", [500_000, 0])
def test_spans(docs, rows, few, monkeypatch):
    monkeypatch.setattr(sanitise, "BROADCAST_WORDS", few)
    wanted = Counter(brute(rows))
    assert any("remove:" in x[-1] for x in wanted) and any("generalise:" in x[-1] for x in wanted)
    assert Counter(map(tuple, sanitise.find_personal(docs).collect())) == wanted
    assert sanitise.find_personal(docs.limit(0)).count() == 0


def test_a_table_of_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    assert Counter(map(tuple, sanitise.find_personal(docs).collect())) == Counter(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_sanitised_texts(docs, rows):
    shown = {"remove": "[...]", "generalise": "[word]"}
    wanted = Counter()
    for (key, text), (*_, spans) in zip(rows, brute(rows), strict=True):
        cuts = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
        out, done = [], 0
        for start, end, kind in cuts:
            if -end > done:
                out += [(text or "")[done : max(start, done)], shown.get(kind, f"[{kind}]")]
                done = -end
        wanted[key, "".join([*out, (text or "")[done:]])] += 1
    assert Counter(map(tuple, sanitise.sanitised(docs).collect())) == wanted
