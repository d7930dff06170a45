"""Decontamination, licenses, secrets and personal data."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from assaykit.llm import decontaminate, licenses, pii, secrets
from assaykit.llm.license_texts import templates
from assaykit.llm.text import WORD_RE

TEMPLATES = templates()
SOME = {n: t for i, (n, t) in enumerate(sorted(TEMPLATES.items())) if len(t) < 3000 and (i % 4 == 0 or "statement" not in n)}
W = [f"word{i}" for i in range(500)]


def test_contamination(table, spark):
    rng = random.Random(1)
    items = [" ".join(rng.choice(W) for _ in range(n)) for n in (20, 40, 9, 3)] + [None, "", "É" + " über-Öl" * 10]
    items.append(items[0])
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    clean = [" ".join(rng.choice(W) for _ in range(80)) for _ in range(30)]
    dirty = [f"İ! before {items[0].upper().replace(' ', ' -- ')} after", f"x {' '.join(items[1].split()[10:25])} y", f"q, {items[2]}.", items[6], items[3]]
    docs = table([*clean, *dirty, None, "", "..."])
    found = decontaminate.find_contamination(docs, bench).collect()
    texts = [*clean, *dirty]
    got = {(r.doc_id - len(clean), r.item_id) for r in found}
    assert got == {(0, 0), (0, 7), (1, 1), (2, 2), (3, 6), (4, 3)}
    for r in found:
        told = decontaminate.normalise(texts[r.doc_id][r.start : r.end]).strip()
        assert told in decontaminate.normalise(items[r.item_id]) and len(told.split()) == r.words
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [*range(30), 34, 35, 36, 37]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, least=3).collect()) == [*range(30), 35, 36, 37]


def test_short_answers_and_odd_rows(table, spark):
    """Answers of one and two words are found, whatever stands around them; null ids, repeated rows and a very long text."""
    bench = spark.createDataFrame([(1, "deep blue", "Who won?"), (None, "Göteborg", None), (3, "", " . ")], "item_id long, text string, answer string")
    long = "x " * 400_000 + "DEEP\n\tBlue " + "y " * 300_000
    rows = [(7, "It was Deep-Blue; deep blues not", "en", "s")] * 2 + [(None, "in göteborg, GÖTEBORG", "en", "s"), (9, long, "en", "s"), (10, "Who Won, deep", "en", "s"), (11, None, "en", "s")]
    found = decontaminate.find_contamination(table(rows), bench, item_texts=("text", "answer")).collect()
    got = sorted((r.doc_id or 0, r.item_id or 0, r.start, r.end, r.words) for r in found)
    # two passages that touch are one
    assert got == [(0, 0, 3, 21, 2), (7, 1, 7, 16, 2), (7, 1, 7, 16, 2), (9, 1, 800_000, 800_010, 2), (10, 1, 0, 7, 2)]


def brute_passages(text, item, window):
    d, w = decontaminate.normalise(text).split(), decontaminate.normalise(item).split()
    k, marked = min(window, len(w)), set()
    runs = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    for i in range(len(d) - k + 1):
        if tuple(d[i : i + k]) in runs:
            marked.add(i)
    out = []
    for i in sorted(marked):
        if out and i <= out[-1][1]:
            out[-1][1] = i + k
        else:
            out.append([i, i + k])
    return [(a, z) for a, z in out]


def test_passages_by_brute_force():
    rng = random.Random(9)
    for window in (1, 2, 5, 13):
        items = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(12)]
        machine = decontaminate.Machine(list(enumerate(items)), window)
        for _ in range(30):
            text = " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))
            want = {(k, 2 * a, 2 * z - 1, z - a) for k, item in enumerate(items) for a, z in brute_passages(text, item, window)}
            assert set(machine.passages(text)) == want


def test_contamination_by_brute_force(table, spark):
    rng = random.Random(2)
    items = [" ".join(rng.choice(W[:8]) for _ in range(16)) for _ in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [" ".join(rng.choice(W[:8]) for _ in range(60)) for _ in range(40)]
    for i in range(0, 40, 3):
        docs[i] += " " + items[i % 4][: rng.randrange(20, len(items[0]))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(table(docs), bench).collect()}
    runs = [{" ".join(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)} for t in items]
    assert got == {(d, i) for d, t in enumerate(docs) for i, r in enumerate(runs) if any(f" {x} " in f" {t} " for x in r)}


def test_no_benchmark(table, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(table(["a b c"]), none).count() == 0
    assert decontaminate.find_contamination(table([]), none).count() == 0


def test_license_places_in_the_original(table):
    text = "İİİİ " + "x " * 200_000 + "Released under the MIT License."
    rows = [(None, text, "en", "s"), (1, "Released under the MIT License. " * 2, "en", "s"), (1, "Released under the MIT License. " * 2, "en", "s")]
    found = licenses.find_licenses(table(rows)).collect()
    assert {text[r.start : r.end] for r in found if r.doc_id is None} == {"Released under the MIT License"}
    assert Counter((r.doc_id, r.license) for r in found)[1, "MIT line"] in (2, 4)
    same = licenses.find_licenses(table(["Released under the MIT License."]), texts={"a": "released under the mit license", "b": "Released under the MIT license"}).collect()
    assert sorted(r.license for r in same) == ["a", "b"]


def test_each_template_is_found_in_itself(table):
    names = list(TEMPLATES)
    found = {(r.doc_id, r.license) for r in licenses.find_licenses(table([TEMPLATES[n] for n in names])).collect()}
    assert {(i, n.partition(":")[0]) for i, n in enumerate(names)} <= found
    version3 = names.index("GPL-3.0 statement:0.0")
    assert {n for i, n in found if i == version3} == {"GPL-3.0 statement"}
    said = ["Distributed under the MIT License", "SPDX-License-Identifier: GPL-2.0-only", "licensed under the GNU General Public License, version 2", "Available under the Eclipse Public License 2.0."]
    assert {r.doc_id for r in licenses.find_licenses(table(said)).collect()} == {0, 1, 2, 3}


def brute_licenses(text):
    w = WORD_RE.findall(text.lower())
    out = set()
    for name, t in SOME.items():
        x = WORD_RE.findall(t.lower())
        want = {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
        reach = (len(x) - 2) * 3 // 2 + 3
        mine = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hits = [i for i, s in enumerate(mine) if s in want]
        if any(len({mine[j] for j in hits if i <= j <= i + reach}) >= (0.8 if len(want) >= licenses.SHORT else 1) * len(want) for i in hits):
            out.add(name.partition(":")[0])
    return out


def test_licenses(table):
    rng = random.Random(3)
    texts = [None, "", "MIT", "the mit license is fine"]
    for name, t in SOME.items():
        filler = [rng.choice(W) for _ in range(rng.randrange(0, 200))]
        words = t.split()
        if len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        at = rng.randrange(len(filler) + 1)
        texts.append(" ".join(filler[:at] + words + filler[at:]))
        texts.append(" ".join(filler))
        texts.append(" ".join(words[: len(words) // 2]))
    found = licenses.find_licenses(table(texts), texts=SOME).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.license)
        span = texts[r.doc_id][r.start : r.end].lower()
        assert r.containment >= 0.8 and span[0].isalnum() and (r.end - r.start) >= 10
    want = {i: b for i, t in enumerate(texts) if t and (b := brute_licenses(t))}
    assert sum(len(v & got.get(k, set())) for k, v in want.items()) >= 0.95 * sum(map(len, want.values()))
    assert all(v <= want.get(k, set()) for k, v in got.items())
    assert licenses.find_licenses(table([])).count() == 0 and licenses.find_licenses(table(["a b c d"]), texts={}).count() == 0


def test_secrets(table):
    live, shared = "9f8Kd02mQz71LpXw55Tb", "Zk3LmQ81xYv0Rb72NsWe"
    rows = [(1, f'api_key = "{live}" and again token: {live}', "en", "o1/r1"), (2, f"token={live}", "en", "o1/r2"), (None, f"secret: {live}", "en", None)]
    rows += [(10 + i, f"password = {shared}", "en", f"o{i}/r") for i in range(3)] + [(20, "token=example_token_0123456", "en", "o1/r1"), (21, "secret = aaaaaaaaaaaaaaaaaaaa", "en", "o1/r1"), (22, None, "en", "o"), (23, "", "en", "o")]
    rows += [(24, "AKIA" + "ABCDEFGHIJKLMNOP" + " ghp_" + "a1B2c3D4e5F6g7H8i9J0kk", "en", "o9/x")]
    found = secrets.find_secrets(table(rows)).collect()
    by = {(r.doc_id, r.kind, r.secret_sha256[:4]): r for r in found}
    first = next(r for r in found if r.doc_id == 1)
    assert (first.occurrences, first.documents, first.repositories, first.owners, first.verdict) == (2, 3, 3, 2, "live")
    assert {r.verdict for r in found if r.doc_id in (10, 11, 12)} == {"shared_example"}
    assert [r.verdict for r in found if r.doc_id == 20] == ["placeholder"] and [r.verdict for r in found if r.doc_id == 21] == ["weak"]
    assert {r.kind for r in found if r.doc_id == 24} == {"aws", "github"} and len(by) == len(found)
    assert not any(live in str(r) for r in found) and secrets.find_secrets(table([])).count() == 0


def test_secrets_of_null_sources_and_ids(table):
    """A null source is an owner of its own, apart from the empty one; rows without an id are one document."""
    secret = "Qx81LmZ0vY27RkWp33Tn"
    long = "w " * 500_000 + f"token={secret}"
    rows = [(1, f"token={secret}", "en", None), (2, f"token={secret}", "en", ""), (3, long, "en", "b"), (None, f"token={secret}", "en", "b"), (None, f"token={secret}", "en", "b")]
    found = secrets.find_secrets(table(rows)).collect()
    assert {(r.owners, r.repositories, r.documents, r.verdict) for r in found} == {(3, 3, 4, "shared_example")}
    assert sorted((r.doc_id or 0, r.occurrences) for r in found) == [(0, 2), (1, 1), (2, 1), (3, 1)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d, t, s) for d, t, _, s in rows])
    names = ["doc_id", "kind", "secret_sha256", "occurrences", "documents", "repositories", "owners", "verdict"]
    assert Counter(db.execute(f"SELECT {', '.join(names)} FROM ({secrets.oracle_sql()})").fetchall()) == Counter(tuple(r[n] for n in names) for r in found)


def test_pii(table):
    rng = random.Random(5)
    card = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    private = [f"é {rng.choice(W)} user{i}.x@mail{i % 9}.example.com, {rng.choice(W)}" for i in range(40)] + [f"call +1 ({200 + i}) 555-{1000 + i} now" for i in range(40)]
    private += [f"{rng.choice(W)} {card()} {rng.choice(W)}" for _ in range(40)] + [f"from 83.{i}.25.12 {rng.choice(W)}" for i in range(40, 80)]
    clean = [" ".join(re.sub(r"\d", "", rng.choice(W)) for _ in range(30)) for _ in range(40)] + ["version 1.2.3 of 2024", "a @ b", "127.0.0.1", None, "", "token = 9f8e7d6c5b4a39281706f5e4d3c2b1a009182736"]
    texts = [*private, *clean]
    found = pii.find_personal_data(table(texts)).collect()
    assert len({r.doc_id for r in found if r.doc_id < len(private)}) >= 0.95 * len(private)
    assert not {r.doc_id for r in found} & {len(private) + i for i in [*range(41), 43, 44, 45]}
    for r in found:
        assert texts[r.doc_id][r.start : r.end].strip() == texts[r.doc_id][r.start : r.end] != ""
    assert pii.find_personal_data(table([])).count() == 0 and pii.find_personal_data(table([None, "x"])).count() == 0


FORMATS = {
    "phone": ["+15551234567", "5551234567", "+33612345678", "+33 6 12 34 56 78", "030 1234567", "(555) 1234567", "+49 170 1234567", "+49 (0)170 1234567", "+1 (999) 999-9999", "555.123.4567", "06 12 34 56 78"],
    "ipv6": ["2a02:26f0:41:1a3:0:0:0:7e", "2a02:26f0::7e", "dead:beef:cafe:babe:dead:beef:cafe:babe", "fe80::1ff:fe23:4567:890a", "::ffff:83.12.25.12"],
    "iban": ["DE89370400440532013000", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606"],
    "street": ["12 Main Street", "1600 Pennsylvania Ave", "221 North 5th St", "77 Old Mill Rd"],
    "account": ["4111111111111111", "4111 1111 1111 1111", "4111 - 1111 - 1111 - 1111"],
    "email": ["jane.doe@example.org", "a" * 80 + "@example.org"],
    "ip": ["83.12.25.12"],
    "ssn": ["219-09-9998"],
    "name": ["Mary Jones", "Dr. Okafor", "Jürgen von Müller".replace("von ", ""), "Frau Schmidt", "John Q. Public", "María Núñez"],
}


def test_pii_formats():
    for kind, spans in FORMATS.items():
        for span in spans:
            text = f"é see {span}, and so on"
            assert [(k, text[a:z]) for k, a, z in pii.spans(text)] == [(kind, span)]
    assert not list(pii.spans("3141592653589793238462643 and 12 345 or a::: b"))


def test_pii_formats_are_scored(table):
    """Each format is told among plain texts with numbers that mean nothing."""
    told = [(k, s) for k, spans in FORMATS.items() for s in spans]
    texts = [f"note {i}: see {s}, thanks" for i in range(12) for _, s in told]
    plain = [f"at 12:{i:02}:56 in version 3.14159{i:03}, 7 ways to find a way, 20240{1 + i % 9}17" for i in range(60)]
    found = pii.find_personal_data(table([*texts, *plain])).collect()
    got = {(r.kind, texts[r.doc_id][r.start : r.end]) for r in found if r.doc_id < len(texts)}
    assert got >= set(told)
    assert not [r for r in found if r.doc_id >= len(texts)]
    letters = "dead:beef:cafe:babe:dead:beef:cafe:babe"
    assert {r.kind for r in pii.candidates(table([letters]), "doc_id", "text").collect()} == {"ipv6"}


def em_by_span(rows, rounds=200):
    """EM over the spans themselves, one kind at a time."""
    out = {}
    for kind in {k for k, _ in rows}:
        votes = [v for k, v in rows if k == kind]
        share, hit, alarm = 0.7, [0.9] * 4, [0.2] * 4
        for _ in range(rounds):
            q = []
            for v in votes:
                yes, no = share, 1 - share
                for j, x in enumerate(v):
                    if x >= 0:
                        yes *= hit[j] if x else 1 - hit[j]
                        no *= alarm[j] if x else 1 - alarm[j]
                q.append(yes / (yes + no))
            share = (sum(q) + 7) / (len(q) + 10)
            for j in range(4):
                said = [(p, v[j]) for p, v in zip(q, votes) if v[j] >= 0]
                hit[j] = (sum(p for p, x in said if x) + 9) / (sum(p for p, _ in said) + 10)
                alarm[j] = (sum(1 - p for p, x in said if x) + 2) / (sum(1 - p for p, _ in said) + 10)
        out[kind] = share, hit, alarm
    return out


def test_pii_by_brute_force(table):
    """The query's rows from all spans, votes, EM and classifier in plain Python; with repeated rows, null ids and a very long
    text."""
    rng = random.Random(4)
    texts = [f"{rng.choice(W)} {rng.choice(['call', 'see', 'order', 'from'])} {rng.choice(FORMATS[rng.choice(sorted(FORMATS))])} {rng.choice(['now', 'thanks', W[3]])}" for _ in range(150)]
    texts += ["version 1.2.3.4 of 2024-01-02", "page 123 456 7890", texts[0], "y " * 100_000 + "mail jane@example.org " + "z " * 100_000]
    rows = [(i if i % 10 else None, t, "en", "s") for i, t in enumerate(texts)]
    got = Counter((r.doc_id, r.kind, r.start, r.end, round(r.score, 9)) for r in pii.find_personal_data(table(rows)).collect())
    found = []
    for d, t, *_ in rows:
        for kind, a, z in pii.spans(t):
            around = pii.surroundings(t, a, z)
            found.append((d, kind, a, z, pii.votes(kind, t[a:z], *around), pii.features(kind, t[a:z], *around)))
    known = em_by_span([(k, v) for _, k, _, _, v, _ in found])
    train = sorted(([k, list(v), f] for _, k, _, _, v, f in found), key=lambda r: (r[0], r[1], r[2]))
    q = []
    for k, v, _ in train:
        share, hit, alarm = known[k]
        yes, no = share, 1 - share
        for j, x in enumerate(v):
            if x >= 0:
                yes, no = yes * (hit[j] if x else 1 - hit[j]), no * (alarm[j] if x else 1 - alarm[j])
        q.append(yes / (yes + no))
    w = pii.fit_spans([f for *_, f in train], np.array(q))
    scores = [1 / (1 + np.exp(-w[f].sum())) for *_, f in found]
    want = Counter((d, k, a, z, round(s, 9)) for (d, k, a, z, *_), s in zip(found, scores) if s >= pii.SCORE)
    assert {x[:4] for x in got} == {x[:4] for x in want} and sum(got.values()) == sum(want.values())
    assert sum((got & want).values()) >= 0.99 * sum(want.values())


def test_names():
    for text, said in (("He met Mary Jones today", ["Mary Jones"]), ("Apache License", []), ("The The", []), ("mail to Dr Who@x.org", ["Dr"][:0]), ("Peter said", [])):
        assert [text[a:z] for k, a, z in pii.spans(text) if k == "name"] == said


def test_reliabilities():
    rng = random.Random(6)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.7
        v = tuple(int(rng.random() < (h if y else a)) if rng.random() < 0.9 else -1 for h, a in ((0.95, 0.1), (0.8, 0.2), (0.9, 0.3), (0.7, 0.4)))
        counts[("k", v)] = counts.get(("k", v), 0) + 1
    share, hit, alarm = pii.reliabilities(counts)["k"]
    assert abs(share - 0.7) < 0.08 and abs(hit[0] - 0.95) < 0.06 and abs(alarm[0] - 0.1) < 0.1
