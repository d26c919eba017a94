"""Hard negatives, filter audit and license scan against brute-force versions, on tables with nulls,
empty and long texts, ties, repeated rows and clashing column names."""

import math
import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from evlens.llm import filter_audit, hard_negatives, license_scan, spans

# --- hard negatives ---------------------------------------------------------------

NAN, INF = float("nan"), float("inf")


def vectors():
    rnd = random.Random(3)
    rows = [(k, [rnd.choice([rnd.uniform(-1, 1), 0.5, -0.5]) for _ in range(13)], k % 4) for k in range(420)]
    for k in (7, 50, 120):  # ties and repeated rows
        rows.append(rows[k])
        rows.append((1000 + k, rows[k][1], rows[k][2]))
    rows += [(100, rows[100][1], rows[100][2]), (2000, None, 1), (2100, [None] * 13, 1), (2200, [NAN] * 13, 1),
             (2300, [INF] + [0.0] * 12, 1), (2400, [0.25] * 13, None), (None, [0.5] * 13, 1), (2500, [], 2),
             (2600, [1.0, -1.0], 3), (-100, [0.75] * 13, 0), (2700, [-3.5] * 13, 2)]
    return [(i, v, lab, "x", "y", "z") for i, v, lab in rows]


VECTORS = vectors()
V_SCHEMA = "vec_id long, embedding array<float>, label int, id string, slot string, score string"


def brute_negatives(rows, positives, negatives):
    seen = []
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        seen.append((i, lab, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, q in sorted(set(r for r in seen if r[0] % 100 == 0)):
        other = sorted((-dot(q, w), j, m) for j, m, w in seen if j != i)
        for s, p, _ in [x for x in other if x[2] == lab][:positives]:
            fits = [x for x in other if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, parts=4, **how):
    df = spark.createDataFrame(rows, V_SCHEMA).repartition(parts)
    df = df.withColumn("q", hard_negatives.quantise(F.col("embedding")))
    out = hard_negatives.hard_negatives(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), **how)
    assert [f.simpleString() for f in out.schema] == [
        "anchor_id:bigint", "positive_id:bigint", "rank:int", "negative_id:bigint", "positive_score:bigint", "negative_score:bigint"]
    return sorted(tuple(r) for r in out.collect())


def test_hard_negatives_equal_brute_force(spark):
    want = brute_negatives(VECTORS, 5, 10)
    assert len(want) > 100
    assert mined(spark, VECTORS) == want
    assert mined(spark, VECTORS, parts=1, block=3) == want  # several passes over the candidates


def test_hard_negatives_few_rows_and_empty(spark):
    few = [r for r in VECTORS if r[0] in (0, 4, 1, 2, 100, 200)]
    assert mined(spark, few) == brute_negatives(few, 5, 10)
    assert mined(spark, [r for r in VECTORS if r[0] == 100]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(100, [], 1, "", "", ""), (101, [], 1, "", "", ""), (102, [], 2, "", "", "")]) == [
        (100, 101, 1, 102, 0, 0)]


def test_hard_negatives_one_label_for_most_rows(spark):
    rows = [(k, [0.5] * 8, 1 if k % 50 else 2, "", "", "") for k in range(600)]
    rows = [(i, [x * (1 + i % 3) / 3 for x in v], lab, *rest) for i, v, lab, *rest in rows]
    assert mined(spark, rows) == brute_negatives(rows, 5, 10)


@pytest.mark.parametrize("least,most", [(-1, 0), (-256, 255), (0, 0), (-5000, 70), (-(1 << 20), 1 << 20)])
def test_tables_give_exact_products(least, most):
    rng = np.random.default_rng(5)
    a, c = rng.integers(least, most + 1, (9, 24)), rng.integers(least, most + 1, (50, 24))
    planes = max(int(least).bit_length(), int(most).bit_length()) + 1
    got = hard_negatives.SubsetTables(a, planes).scores(hard_negatives.pack_planes(c, planes))
    assert np.array_equal(got, c @ a.T)


def test_too_large_components_are_refused(spark):
    rows = [(100, [3e38] * 8, 1, "", "", ""), (1, [1.0] * 8, 1, "", "", "")]
    with pytest.raises(ValueError):
        mined(spark, rows)


# --- filter audit -----------------------------------------------------------------

def texts():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdeXYZ") for _ in range(rnd.randint(1, 12))) for _ in range(120)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [prose(rnd.randint(0, 140)) for _ in range(60)]
    out += [out[3], out[3], out[7], "la " * 60, "LA " * 60, "a|b", "été 　x " * 60, "", None, None, " \t\n", "w" * 500,
            ("v" * 70 + " ") * 55, ("v" * 70 + " " + "v" * 71 + "\x0b") * 40, "漢字" * 400, "x\x85y z" * 30, prose(20000),
            "\x00a \x00a \x1fb" * 30]
    return out


DOC_SCHEMA = "doc_id long, text string, source string, n string, part string, failed string, id string"


def audit_rows():
    rows = [(k, t, f"s{k % 3}" if k % 10 else None) for k, t in enumerate(texts())]
    rows += [(3, rows[3][1], "s0"), (None, rows[3][1], "s1"), (None, None, None), (None, rows[4][1], ""), (-5, rows[9][1], "s2")]
    return [r + ("n", "p", "f", "i") for r in rows]


LABELS = [(k, k % 2, (k // 3) % 2) for k in range(0, 70, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]


def brute_audit(rows, labels):
    good, toxic = ({i for i, *flags in labels if i is not None and flags[at] == 1} for at in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, part, *_ in rows:
        t = t or ""
        w = regex.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(regex.findall("[A-Z]", t)) > 5 * len(t), "D": bool(regex.search(r"[#$%&*|]", t)),
                 "E": i is not None and least[t] < i}
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[0] for d in mine) - len(gone), sum(d[0] == {f} for d in mine),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(tuple(r) for r in got.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    want = brute_audit(rows, LABELS)
    assert len(want) == 600 * len({r[2] or "" for r in rows})
    assert audited(spark, rows, LABELS) == want
    assert any(r[4] for r in want) and any(r[5] for r in want) and any(r[8] for r in want)


def test_audit_edges(spark):
    assert audited(spark, [], LABELS) == []
    rows = [(k, "same text " * 9, "a", "", "", "", "") for k in range(40)] + [(1, "same text " * 9, "b", "", "", "", "")]
    assert audited(spark, rows, []) == brute_audit(rows, [])


def test_statistics_in_slices_of_a_buffer():
    data = texts()
    for lo, hi in ((0, len(data)), (5, 6), (62, len(data) - 1)):
        got = filter_audit.text_statistics(pa.array(data, pa.string()).slice(lo, hi - lo))
        for k, t in enumerate(data[lo:hi]):
            w = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
            assert (got["words"][k], got["distinct"][k], got["points"][k]) == (len(w), len(set(w)), len(t or "")), k


def test_hash_table_verifies_bytes(monkeypatch):
    """With a hash that gives every word one value, distinct words are still told apart."""
    monkeypatch.setattr(spans, "span_hash", lambda raw, start, size: np.zeros(len(start), dtype=np.uint64))
    data = ["a b a ab ba bé abcdefghij abcdefghik abcdefghij " * 3, "a a", ""]
    assert filter_audit.text_statistics(pa.array(data))["distinct"].tolist() == [7, 1, 0]


# --- license scan -----------------------------------------------------------------

def edited(phrase, edits, rnd, first=0):
    s = list(phrase)
    for _ in range(edits):
        at = rnd.randrange(first, len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[at] = rnd.choice("abz9é")
        elif kind == 1 and len(s) > first + 1:
            del s[at]
        else:
            s.insert(at, rnd.choice("aq7漢"))
    return "".join(s)


def license_rows():
    rnd = random.Random(17)
    words = ["license", "licence", "mit", "public", "general", "the", "apache", "open", "résumé", "code", "x1"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = ["MIT License", "mit-LICENSE, Apache   license", "xmit license", "mit licenses", "General\nPublic\tLicense general public license",
           None, "", " .,- ", "mit é license", "permit license", "mit\x00license", "licensemit license mit", "émit license",
           "mit license" * 3, "Apache Licénse", "all rights reserved", "mit license mit license apache", "bit license", prose(30000)]
    for notice in license_scan.NOTICES:
        for edits in range(notice.edits + 2):
            for _ in range(6):
                s = edited(notice.phrase, edits, rnd, len(notice.exact))
                out.append(f"{prose(rnd.randint(0, 6))} {s.title() if rnd.random() < .3 else s}, {prose(rnd.randint(0, 6))}")
    return [(k, t, "n", "m", "l", "s") for k, t in enumerate(out)] + [(None, "mit license", "n", "m", "l", "s"), (0, "MIT License", "n", "m", "l", "s")]


def fewest_edits(phrase, text):
    """Fewest edits between the phrase and any part of the text that begins and ends at a word's edge."""
    m, best = len(phrase), len(phrase) + 1
    row = list(range(m + 1))
    for j, ch in enumerate(text + " "):
        if j and ch == " ":
            best = min(best, row[m])
        if ch == " ":
            fresh = 0  # a match may begin after this space
        else:
            fresh = None
        # Column for text[:j + 1]; a new start is possible only behind a space (or at the front).
        new = [min(row[0] + 1, fresh) if fresh is not None else row[0] + 1]
        for i in range(1, m + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (phrase[i - 1] != ch)))
        row = new
    return best


def brute_scan(text):
    low = regex.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels, score = [], set(), 0.0
    for notice in license_scan.NOTICES:
        want = notice.phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(want)] == want]
        if notice.base:
            places += [(i, notice.label) for i in at]
        if len(words) > 5000:  # the long text: exact places only
            if at:
                labels.add(notice.label)
            continue
        joined = " ".join(words)
        if notice.exact:
            head = notice.exact.split()
            starts = [i for i in range(len(words)) if words[i:i + len(head)] == head]
            rest = notice.phrase[len(notice.exact):]
            edits = min((anchored_edits(rest, " ".join(words[i + len(head):i + len(head) + 8])) for i in starts), default=99)
        else:
            edits = fewest_edits(notice.phrase, joined)
        if edits <= notice.edits:
            labels.add(notice.label)
            score = max(score, 1 - edits / len(notice.phrase))
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in places})),
            ",".join(sorted(labels)), score if len(words) <= 5000 else None)


def anchored_edits(rest, text):
    """Fewest edits between ``rest`` and a beginning of the text that ends at a word's edge."""
    row, best = list(range(len(rest) + 1)), 99
    for j, ch in enumerate(text + " "):
        if ch == " " and j:
            best = min(best, row[-1])
        new = [row[0] + 1]
        for i in range(1, len(rest) + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (rest[i - 1] != ch)))
        row = new
    return best


def test_licenses_equal_brute_force(spark):
    rows = license_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, score string, labels string, spans string").repartition(3)
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by_text = {r[1]: brute_scan(r[1]) for r in rows}
    texts = {r[0]: r[1] for r in rows}
    texts[None] = "mit license"
    wrong = []
    for r in got:
        want = by_text[texts[r["doc_id"]]]
        have = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
        if have[:6] != want[:6] or (want[6] is not None and abs(have[6] - want[6]) > 1e-9):
            wrong.append((texts[r["doc_id"]][:90], have, want))
    assert not wrong, wrong[:5]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_spans_name_the_words():
    scanner = license_scan.Scanner(license_scan.NOTICES)
    row, other = license_scan.scan_texts(scanner, pa.array(["see the É MIT  licence, here: mit License.", "nothing"]))
    spans = [(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in row["spans"]]
    assert spans == [("mit", 3, 4, 1), ("mit", 6, 7, 0)]
    assert (row["n_base"], row["first_word"], row["last_word"], other["spans"], other["score"]) == (1, 6, 6, [], 0.0)


def test_empty_table_and_slices(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan_licenses(empty).collect() == []
    data = pa.array(["mit license", None, "apache license", ""]).slice(1, 3)
    got = license_scan.scan_texts(license_scan.Scanner(license_scan.NOTICES), data)
    assert [(r["n_words"], r["base_labels"]) for r in got] == [(0, ""), (2, "apache"), (0, "")]
