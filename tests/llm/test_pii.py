import math
import random
import re

from pyspark.sql import functions as F

from tidewire.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def test_entities_equal_plain_patterns(spark, documents):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", ".", "-", "x@y.z", "_", "12", "255", "256", "0", "1.2.3.4", "999.1.1.1", " ", " ", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-2345", "+44", "(", "é", "🙂", "\n", "%", "+", "10.0.0.1.9.9.9.9"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(600)]
    texts += [None, "", "1" * 30000, "a" * 60000 + "@", "1-" * 20000, "+1" + "(" * 30000, "a@b.c " * 300]
    rows = documents(*texts).select("doc_id", pii.entity_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in rows:
        assert [tuple(x) for x in r["s"]] == brute(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_terms_by_disclosure(spark, documents):
    filler = "common words stand in every text here"
    texts = [f"{filler} about zanzibar trader alice@corp.example who is number{i} common" for i in range(6)]
    texts += [f"{filler} and zanzibar trader again", *[f"{filler} trader plain number{i}x" for i in range(40)], None, ""]
    docs = documents(*texts)
    got = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(docs, threshold=0.0).collect()}
    n, both, alone = len(texts), 6, sum("zanzibar" in (t or "") for t in texts)
    assert math.isclose(got["zanzibar"], 1 - math.log(alone / both) / math.log(n / 6))
    assert math.isclose(got["who"], 1.0) and "corp" not in got and "alice" not in got and "number1" not in got
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [x["kind"] for x in rows[6]["spans"]] == ["term"] and rows[6]["spans"][0]["value"] == "zanzibar"
    assert rows[7]["spans"] == [] and rows[len(texts) - 1]["spans"] == []
    assert [x["value"] for x in rows[0]["spans"]][0] == "alice@corp.example"
    clean = {r["doc_id"]: r for r in pii.sanitise(docs.withColumn("spans", F.lit("clash"))).collect()}
    assert clean[6]["text"] == f"{filler} and [TERM] trader again" and clean[6]["n_chars"] == len(clean[6]["text"])
    assert "[EMAIL]" in clean[0]["text"] and "who" not in clean[0]["text"].split() and clean[7]["text"] == texts[7]
    assert clean[len(texts) - 2]["text"] is None and clean[0]["spans"] == "clash"


def test_repeated_rows_and_empty_table(spark, documents):
    docs = documents("mail a@b.co now", "mail a@b.co now").withColumn("doc_id", F.lit(None).cast("long"))
    rows = pii.find(docs).collect()
    assert len(rows) == 2 and all(len(r["entities"]) == 1 for r in rows)
    assert pii.find(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_overlapping_entities(spark, documents):
    text = "call +1 555 010 2345 1111 or 10.0.0.1 x"
    clean = pii.sanitise(documents(text)).first()["text"]
    assert clean == "call [PHONE] or [IP] x" if any(k == "phone" for k, *_ in brute(text)) else "10.0" not in clean


def test_words_at_the_edges_of_texts(spark, documents):
    texts = [f"zanzibar reach{i} alice@corp.example" for i in range(6)] + [f"alice@corp.example quagga" for _ in range(3)]
    texts += [f"bob@corp.example {'x' * 10}{i} longword" for i in range(6)] + ["something else", None]
    docs = documents(*texts)
    got = {r["term"] for r in pii.disclosing_terms(docs, threshold=0.0, support=2).collect()}
    assert {"zanzibar", "quagga"} <= got
    # the window ends inside the last word: a part of a word is no term
    cut = {r["term"] for r in pii.disclosing_terms(docs, threshold=0.0, support=2, context=17).collect()}
    assert not {t for t in cut if t != "longword" and "longword".startswith(t)} and "longword" not in cut
    clash = docs
    for name in ("pii_key", "pii_entities", "pii_terms", "pii_spans", "pii_strong", "pii_done", "pii_clean", "pii_row"):
        clash = clash.withColumn(name, F.lit("own"))
    rows = pii.sanitise(clash, support=2, threshold=0.5).collect()
    assert rows[0].asDict().keys() == set(clash.columns) and all(r[c] == "own" for r in rows for c in clash.columns if c.startswith("pii_"))
    assert sorted(str(r["text"]) for r in rows) == sorted(str(r["text"]) for r in pii.sanitise(docs, support=2, threshold=0.5).collect())
