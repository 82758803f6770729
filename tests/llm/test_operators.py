"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import blocks, decontaminate, mixing, multi_index, ngram_join, passage_dedup, pii, quality, secrets, shared_codes, substring_dedup, suffixes, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, label string"
WORDS = [f"w{i}" for i in range(400)] + ["Ünï", "ñandú", "PASS"]


def corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage, line, base = say(60), say(9), say(80)
    rows: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "ONE two\nthree"), (7, base), (8, base), (8, base), (9, base.upper())]
    for i in range(10, 60):
        words = base.split()
        for _ in range(rng.choice([0, 1, 2, 6])):
            words[rng.randrange(80)] = rng.choice(WORDS)
        kind = i % 5
        rows.append((i, {0: " ".join(words), 1: f"{say(30)} {passage} {say(20)}", 2: "\n".join([line] * rng.randrange(1, 7)), 3: say(rng.randrange(1, 200)), 4: f"{passage[:250]} {say(5)} {passage}"}[kind]))
    rows += [(60, say(6000)), (61, "a" * 3000), (62, "ab" * 500 + " x " + "ab" * 300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 3 else f"s{(i or 0) % 4}", 0, "k", "s", "l") for i, t in rows], SCHEMA).repartition(3)


def test_ngram_join(spark):
    rows = corpus()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    want = sorted((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows)))
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect())) == want
    kept = ngram_join.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({b[2] for b in want if b[1]} | {b[0] for b in want if not b[1]})
    assert kept.columns == frame(spark, rows).columns
    assert ngram_join.ngram_join(frame(spark, rows).limit(0)).count() == 0


def test_blocks_of_lists_meet_every_pair_that_matters_once_or_more(spark):
    rng = random.Random(9)
    rows = [(1, k, size := rng.choice([8, 9, 10, 11, 13, 15, 40, 41, 90]), 7 if k % 3 else rng.randrange(20), size, b"") for k in range(400)]
    rows += [(2, k, 10, k % 2, 10, b"") for k in range(5)] + [(3, k, 10, 1, 10, b"") for k in range(50)]
    lists = spark.createDataFrame(rows, "token long, key long, size long, label long, own long, bitmap binary")
    got = ngram_join.blocks_of_lists(lists, 75, block=16).collect()
    blocks_ = {}
    for r in got:
        blocks_.setdefault((r["token"], r["class"], r["low"], r["high"]), []).append(r)
    met = set()
    for (token, _, low, high), members in blocks_.items():
        assert len(members) < 200
        met |= {(token, min(a["key"], b["key"]), max(a["key"], b["key"])) for a in members if a["part"] == low for b in members if b["part"] == high and a["key"] != b["key"]}
    for i, (token, k, size, label, *_) in enumerate(rows):
        for other, l, size_, label_, *_ in rows[:i]:
            if token == other and label != label_ and 100 * min(size, size_) >= 75 * max(size, size_):
                assert (token, min(k, l), max(k, l)) in met
    assert not [x for x in met if x[0] == 3]  # of one component
    assert len(got) < 400 * 2 * 12


def test_keep_one_with_ids_on_several_texts(spark):
    rng = random.Random(1)
    one, two, three = (" ".join(rng.choices(WORDS, k=40)) for _ in range(3))
    rows = [(5, one), (5, two), (5, one), (3, two + " more"), (None, three), (None, three), (8, three), (9, None), (9, None), (2, ""), (1, one + " again")]
    table = frame(spark, rows).withColumns({"drop_id": F.lit(1), "twice_id": F.lit(2), "code": F.lit(3), "row_code": F.lit(4), "id": F.lit(5)})
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, one + " again"), (3, two + " more"), (8, three), (None, three), (None, three), (9, None), (9, None), (2, "")], key=str)
    assert ngram_join.keep_one(table.limit(0)).count() == 0


@pytest.mark.parametrize(("run", "length", "words"), [(substring_dedup.remove_repeated_bytes, 400, False), (passage_dedup.remove_repeated_passages, 35, True), (substring_dedup.remove_repeated_bytes, 40, False)])
def test_repeats(spark, run, length, words):
    rows = corpus(5)
    units = [WORD.findall(t or "") if words else (t or "").encode() for _, t in rows]

    def covered(size: int) -> list[np.ndarray]:
        seen = Counter(hash(tuple(u[i : i + size]) if words else u[i : i + size]) for u in units for i in range(len(u) - size + 1))
        out = []
        for u in units:
            gone = np.zeros(len(u), bool)
            for i in range(len(u) - size + 1):
                if seen[hash(tuple(u[i : i + size]) if words else u[i : i + size])] > 1:
                    gone[i : i + size] = True
            out.append(gone)
        return out

    want = []
    for (doc, _), u, gone, shared in zip(rows, units, covered(length), covered(length if words else min(length, substring_dedup.SHORT)), strict=True):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g).encode() if words else bytes(np.frombuffer(u, np.uint8)[~gone])
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        want.append((doc, len(u), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *([] if words else [int(shared.sum())])))
    assert words or length < substring_dedup.SHORT or any(w[5] > w[2] for w in want)
    assert sorted(map(tuple, run(frame(spark, rows), length=length).collect())) == sorted(want)
    assert run(frame(spark, rows).limit(0), length=length).count() == 0


@pytest.mark.parametrize("bits", [0, 4, 8, 15, 16, 17, 18, 19, 20])
def test_shared_codes_at_any_number_of_ranges(bits):
    rng = np.random.default_rng(bits)
    pool = rng.integers(0, 2**64, 600, dtype=np.uint64) & ~np.uint64(1)
    texts = [np.unique(pool[rng.integers(0, 600, 200)]) for _ in range(4)]
    twice = [rng.integers(0, 2, len(t), dtype=np.uint64) for t in texts]
    keys = rng.integers(0, 2**64, 4, dtype=np.uint64)
    packed = pa.concat_tables([pa.Table.from_batches([b]) for b in shared_codes._pack([np.arange(4)], [keys], [np.array([len(t) for t in texts])], [t | f for t, f in zip(texts, twice, strict=True)], bits)])
    slots = packed.column("slot").to_pylist()
    run = shared_codes._counter(bits)
    names = ["target", "kind", "ids", "keys", "sizes", "codes"]
    counted = pa.concat_tables([run(packed.filter(pa.array([s == slot for s in slots]))).rename_columns(names) for slot in sorted(set(slots))])
    got = shared_codes.gather(counted)
    seen = Counter(c for t in texts for c in t.tolist())
    for i, key in enumerate(got.keys):
        own = int(np.flatnonzero(keys == key)[0])
        want = np.array([c for c, f in zip(texts[own].tolist(), twice[own].tolist(), strict=True) if seen[c] > 1 or f], np.uint64)
        assert set(got.codes[got.of[i] : got.of[i + 1]].tolist()) == set(shared_codes.visible(want, bits).tolist())


@pytest.mark.parametrize(("run", "length", "words"), [(substring_dedup.remove_repeated_bytes, 400, False), (passage_dedup.remove_repeated_passages, 35, True)])
def test_repeats_beyond_65536_ranges(spark, run, length, words, monkeypatch):
    monkeypatch.setattr(shared_codes, "carried_bits", lambda documents: 18)
    test_repeats(spark, run, length, words)


@pytest.mark.parametrize("seed", range(20))
def test_indexes(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 97 + rng.integers(2, 5), rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 12))] + [b"a" * 30]
    for length in (1, 3, 9):
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
        assert [x.tolist() for x in suffixes.RunIndex(texts).long_matches(length)] == want
        assert [x.tolist() for x in suffixes.WordIndex([np.frombuffer(t, np.uint8).astype(np.uint64) for t in texts]).long_matches(length)] == want


def test_secrets(spark, tmp_path):
    texts = ["ñ password: 'abcdefghijkl' x", "password: secret: token=abcdefghijklmnop", "Api_Key=short AKIA" + "A" * 14 + " " + "0" * 16, None, "", "PASSWD = \"aaaaaaaaaaaaaaaa\"", "x" * 5000 + "AKIA" + "B" * 13]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    want = []
    assign = re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for i, t in rows:
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        want.append((i, *[sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(text.encode()).hexdigest(), text))
    ledger = f"file://{tmp_path}/ledger"
    first = secrets.findings(frame(spark, rows[:4]), ledger).collect()
    assert sorted(map(tuple, first)) == want[:4]
    assert sorted(map(tuple, secrets.findings(frame(spark, rows), ledger).collect())) == want
    scanned = spark.read.parquet(ledger)
    assert scanned.count() == scanned.select("blob", "rule").distinct().count() == 3 * 6  # null and empty are one content
    assert sorted(map(tuple, secrets.findings(frame(spark, rows)).collect())) == want
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{20,}", 0, 20))
    secrets.findings(frame(spark, rows), ledger, newer).collect()
    assert spark.read.parquet(ledger).where("rule = 'hex@2'").count() == 6 and spark.read.parquet(ledger).count() == 24


KEY = b"a key for tests"


def test_secrets_of_many_matches(spark):
    text = " ".join(f"{i:016x}" for i in range(5000)) + " token=" + "x" * 12
    got = secrets.findings(frame(spark, [(1, text)])).first()
    assert got["n_hex"] == 5000 and got["n_assign"] == 1 and got["spans"].split(",")[4999] == f"hex:{17 * 4999}:{17 * 5000 - 1}"


def test_codebooks_grow_and_cells_do_not(monkeypatch, spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(900)]
    seen = []
    fit = multi_index.fit
    monkeypatch.setattr(multi_index, "fit", lambda unit, codes, threshold: seen.append((len(unit), codes)) or fit(unit, codes, threshold))
    monkeypatch.setattr(multi_index, "CODES", 2)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert multi_index.near_vectors(table).count() == 900 and multi_index.near_vectors(table.where("vec_id < 36")).count() == 36
    assert seen == [(900, 10), (36, 2)]


def test_pii(spark):
    texts = ["Mail a.b@mail7.example.com or A.B@mail7.example.com, c.b@mail7.example.com!", "call +1 (852) 555-5043 4186133740741811", "72.162.198.226 then 10.0.0.1 and 4.0", "Mrs. Anna Smith met Mr. Smith; Frau Müller. Later ANNA SMITH left, and Anna's aunt", "GB82 WEST 1234 5698 7654 32, 123-45-6789", None, "", "x" * 20000]
    rows = list(enumerate(texts * 2))
    table = frame(spark, rows).withColumn("n_email", F.lit("own"))
    done = pii.replace_private(table, KEY, counts=True)
    assert done.columns[: len(table.columns) + 1] == [*table.columns, "n_email_"]
    got = {r["doc_id"]: r for r in done.collect()}
    for i in range(len(texts)):
        a, b = got[i]["text"], got[i + len(texts)]["text"]
        assert a == b and (a is None) == (texts[i] is None)
    assert got[7]["text"] == texts[7] and got[6]["text"] == "" and got[0]["n_email_"] == 3 and got[0]["n_email"] == "own"
    mails = re.findall(r"[\w.]+@[\w.]+\w", got[0]["text"])
    assert mails[0].upper() == mails[1].upper() and mails[0] != mails[1] and mails[1][0].isupper() and mails[2] != mails[0]
    assert all(m.endswith(".example.com") and re.fullmatch(r"[a-zA-Z]\.[a-zA-Z]", m.split("@")[0]) for m in mails) and "mail7" not in got[0]["text"]
    phone, card = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) (\d{16})", got[1]["text"]).groups()
    assert phone != "+1 (852) 555-5043" and card != "4186133740741811" and pii.luhn(card) and card[0] == "4"
    assert re.fullmatch(r"[\d.]+ then 10\.[\d.]+ and 4\.0", got[2]["text"]) and "72.162" not in got[2]["text"] and got[2]["n_ip"] == 2
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+); Frau (\w+)\. Later (\w+) (\w+) left, and (\w+)'s aunt", got[3]["text"]).groups()
    assert names[0].endswith("ia") and names[1] == names[2] and names[4:] == (names[0].upper(), names[1].upper(), names[0]) and got[3]["n_name"] == 7
    assert not set(re.findall(r"\w+", texts[3].casefold())) & {n.casefold() for n in names} and all(abs(len(n) - len(o)) <= 3 for n, o in zip(names, ("Anna", "Smith", "Smith", "Müller"), strict=False))
    iban = got[4]["text"].split(",")[0].replace(" ", "")
    assert pii._iban_rest(iban) == 1 and iban != "GB82WEST12345698765432" and got[4]["n_ssn"] == 1
    made = pii.Surrogates(KEY)
    assert sorted(made.step(b"t", x, 97) for x in range(97)) == list(range(97)) and all(made.step(b"t", x, 97) != x for x in range(97))
    assert len({made.of("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"}) == 26
    assert made.of("email", "a@x.org") != pii.Surrogates(b"another").of("email", "a@x.org")
    assert pii.replace_private(frame(spark, []), KEY, counts=True).count() == 0


@pytest.mark.parametrize("form", ["+15551234567", "555 123 4567", "+33 6 12 34 56 78", "06 12 34 56 78", "+49 30 1234567", "+49 170 1234567", "(852) 555-5043", "0612345678", "030 12345678", "+44 (0)20 7946 0958"])
def test_forms_of_phones(form):
    new, found = pii.Surrogates(KEY).rewrite(f"Call {form}, or not.")
    assert found == {"phone": 1} and form not in new and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"Call {form}, or not.")


def test_forms_of_mails_and_plain_numbers():
    made = pii.Surrogates(KEY)
    for text in ("汉" * 70 + "bob@mail.example.com联系", "x" * 100 + ".bob@mail.example.com", "jörg@müller.de", "J.Doe+news@sub.example.org"):
        new, found = made.rewrite(text)
        assert found == {"email": 1} and len(new) == len(text) and new.count("@") == 1 and "bob@" not in new and "rg@m" not in new and "Doe" not in new
    for text in ("on 01.02.2024 and 02-03-2024 at 08:30", "1 000 000 or 3.14 and 2024-01-02", "no @ here @x", "a" * 5000, "Smith went home"):
        assert made.rewrite(text) == (text, Counter())


def test_coreference_of_phones():
    made = pii.Surrogates(KEY)
    digits = lambda t: "".join(re.findall(r"\d", t))
    one = [digits(made.of("phone", t))[-10:] for t in ("+1 (852) 555-5043", "(852) 555-5043", "852-555-5043", "852 555 5043", "+18525555043")]
    assert len(set(one)) == 1 and one[0] != "8525555043"
    two = [digits(made.of("phone", t))[-9:] for t in ("+33 6 12 34 56 78", "06 12 34 56 78", "0612345678")]
    assert len(set(two)) == 1 and digits(made.of("phone", "+33 6 12 34 56 78"))[:2] == "33" and made.of("phone", "06 12 34 56 78")[0] == "0"


def test_distinctness_and_coreference_over_a_corpus(spark):
    rng = random.Random(7)
    first, last = [f"{a}{b}".capitalize() for a in ("an", "be", "cor", "dil", "eve") for b in ("na", "ro", "lia", "mun", "s")], [f"{a}{b}".capitalize() for a in ("smi", "jon", "tay", "bro") for b in ("th", "es", "lor", "wn")]
    rows, said = [], []
    for i in range(120):
        parts = [("name", rng.choice(first)), ("name", rng.choice(last)), ("email", f"{rng.choice(first).lower()}{rng.randrange(9)}@site{rng.randrange(4)}.org"), ("phone", f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"), ("ip", f"77.{rng.randrange(256)}.0.{rng.randrange(256)}")]
        said.append(parts)
        rows.append((i, f"Ms. {parts[0][1]} {parts[1][1]} | {parts[2][1]} | {parts[3][1]} | {parts[4][1]}"))
    got = {r["doc_id"]: r["text"] for r in pii.replace_private(frame(spark, rows), KEY).collect()}
    to, back = {}, {}
    for i, parts in enumerate(said):
        name, *rest = got[i].removeprefix("Ms. ").split(" | ")
        for (kind, old), new in zip(parts, [*name.split(" "), *rest], strict=True):
            assert to.setdefault((kind, old), new) == new  # one surrogate for a value, everywhere
            assert back.setdefault((kind, new), old) == old  # and one value for a surrogate
    for kind in ("name", "email", "phone", "ip"):  # none is a value of the corpus
        assert not {o.casefold() for k, o in to if k == kind} & {n.casefold() for k, n in back if k == kind}


def test_decontamination(spark):
    item = "Alice went to the market and bought 12 apples for 30 cents then Bob sold her 12 pears near the river"
    rows = [(1, f"Noise here. {item} and more"), (2, "Yes. Yesterday " + item.replace("Alice", "Carla").replace("Bob", "Dirk").replace("12", "15").replace("30", "44")), (3, item.replace("12 pears", "13 pears")), (4, "unrelated words only " * 10), (5, None), (6, ""), (7, " ".join(f"Name{i} {i}" for i in range(40)))]
    bench = spark.createDataFrame([(100, item), (101, "short"), (102, None), (None, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(frame(spark, rows * 2), bench).collect()}
    assert set(got) >= {1, 2} and not set(got) & {4, 5, 6, 7} and got[1]["item_id"] == 100 and got[1]["n_equal"] == got[1]["n_slots"]
    assert got[2]["n_equal"] < got[2]["n_slots"] and (3 not in got or got[3]["n_words"] < got[1]["n_words"])
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(frame(spark, rows), bench).collect() if r["doc_id"] != 3) == [4, 5, 6, 7]
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_short_items_and_few_literals(spark):
    items = ["What is 12 + 7 - 3 * 4 + 18 / 6 - 2 + 40 ?", "We met Anna Lee Smith, Bob Ray Jones, Carl May Brown, Dora Sue White and Emil Jan Black", "How many legs do three spiders have in total?", "Name the capital of Peru", "42"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(8, ""), (9, " ")], "item_id long, text string")
    rows = [(i, f"Some words before. {t} And some after") for i, t in enumerate(items)]
    rows += [(10, items[0].replace("12", "13").replace("40", "41").replace("18", "19")), (11, "how many legs do four spiders have in total"), (12, "Please name the capital of Peru."), (13, "Name the capital of Chad now"), (14, " ".join(f"Name{i} {i + 50}" for i in range(40))), (15, None), (16, "")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert set(got) == {(i, i) for i in range(5)} | {(10, 0), (12, 3), (13, 3)}
    assert got[10, 0]["n_equal"] < got[10, 0]["n_slots"]
    assert got[0, 0]["n_words"] == 18 and got[2, 2]["n_words"] == 9 and got[13, 3]["n_equal"] == 0 and got[12, 3]["n_equal"] == 1


NOUNS = ["apples", "pears", "coins", "books", "stamps"]
FRAMES = [
    "{A} has {x1} {n} and {x2} {m}. How many are there?", "{A} gave {B} {x1} {n} at school. Then {B} lost {x2} of them on the way home. How many {n} does {B} have now?",
    "A train runs {x1} km in {x2} hours and then {x3} km in {x4} hours. What is its mean speed over the whole way?", "What is {x1} + {x2} - {x3} * {x4} + {x1} / {x2} - {x3} + {x4} ?",
]


def filled(frame_: str, rng: random.Random, n: str, m: str) -> str:
    people, numbers = rng.sample(["Ann", "Bob", "Cyr", "Dora", "Emil", "Fay"], 2), rng.sample(range(2, 99), 4)
    return frame_.format_map({"A": people[0], "B": people[1], "n": n, "m": m, **{f"x{i}": x for i, x in enumerate(numbers, 1)}})


def test_decontamination_of_templates_with_new_values(spark):
    """By brute force over frames: a text holds the items of its own frame that share 12 words with it but for names and
    numbers (those of the second frame do, whatever its nouns), and no others."""
    rng = random.Random(11)
    kinds = [(f, n, m) for f in FRAMES for n, m in (("apples", "pears"), ("coins", "books"))]
    kinds = [k for i, k in enumerate(kinds) if "{n}" in k[0] or i % 2 == 0]  # one item of each frame without nouns
    items = [filled(f, rng, n, m) for f, n, m in kinds]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows, want = [], set()
    for i, (f, n, m) in enumerate(kinds):
        for j in range(4):
            rows.append((10 * i + j, f"Some words go before it here. {filled(f, rng, n, m)} And others follow it there."))
            want |= {(10 * i + j, k) for k, kind in enumerate(kinds) if kind == kinds[i] or kind[0] == f == FRAMES[1]}
    rows += [(1000 + i, filled(f, rng, "stamps", "lamps")) for i, f in enumerate(FRAMES[:2])]
    want |= {(1001, k) for k, kind in enumerate(kinds) if kind[0] == FRAMES[1]}
    rows += [(1010, "There are 12 + 7 - 3 reasons"), (1011, "A train runs late in 3 hours and then 4 km of it stand")]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()} == want


def test_decontamination_of_names_that_begin_sentences(spark):
    items = ["Tom has 5 red apples. Sara gives Tom 7 more at school. Tom then eats 3 of the apples. How many apples are left?", "Mary paints every fence post along the old river road before winter"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = items[0].replace("Tom", "Ben").replace("Sara", "Lucy").replace("5", "9")
    mixed = other.replace("Ben then", "Carl then")  # not one name for one: only a part of it is the item's
    rows = [(0, other), (1, f"He said {items[1]} and left"), (2, f"He said {items[1].replace('Mary', 'Joan')} and left"), (3, f"We know that {other.replace('Lucy gives', 'then Lucy gives')}"), (4, mixed), (5, "Tom. Sara. Ann. Bob. " * 20), (6, items[1].replace("Mary", "nobody"))]
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert set(got) >= {(0, 0), (1, 1), (2, 1)} and set(got) <= {(0, 0), (1, 1), (2, 1), (3, 0), (4, 0)}
    assert got[0, 0] == (21, 5, 2) and got[1, 1] == (12, 1, 1) and got[2, 1] == (12, 1, 0)
    assert (4, 0) not in got or got[4, 0][0] < 21


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS[:200] if i % 4 else [w.upper() + "!!" for w in WORDS[:200]], k=60))) for i in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in got if r["held_out"] and r["doc_id"] < 400]) > 0.95
    assert quality.keep_good(frame(spark, rows), labels).columns == frame(spark, rows).columns
    assert quality.classify(frame(spark, rows), labels.limit(0)).count() == len(rows)


def plain_features(text: str) -> tuple[set, set]:
    words = WORD.findall(text)
    return set(words), set(zip(words, words[1:], strict=False))


def test_quality_by_its_definition():
    """Features, class ratios, the hinge-loss optimum and scores against plain versions."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS[:30] if i % 2 else WORDS[20:50], k=rng.randrange(3, 30))) for i in range(16)] + [""]
    part = next(blocks.slices(pa.array(texts)))
    row, bucket = quality.features(part)
    docs = [bucket[row == i] for i in range(len(texts))]
    assert [len(d) for d in docs] == [sum(map(len, plain_features(t))) for t in texts]
    one = lambda word: quality.features(next(blocks.slices(pa.array([word]))))[1][0]
    assert all({one(w) for w in plain_features(t)[0]} <= set(d) for t, d in zip(texts, docs, strict=True))
    labels = np.array([1.0 if i % 2 else -1.0 for i in range(16)])
    ratio = quality._log_ratios(docs[:16], labels)
    size, counts = 1 << quality.BUCKET_BITS, [Counter(b for d, y in zip(docs, labels, strict=False) if y == side for b in d.tolist()) for side in (1, -1)]
    for b in {int(b) for d in docs for b in d} | {0, size - 1}:
        p, q = ((c[b] + 1) / (sum(c.values()) + size) for c in counts)
        assert abs(ratio[b] - math.log(p / q)) < 1e-12
    weights, bias = quality.descend(docs[:16], labels, ratio, rounds=2000)
    x = np.zeros((16, size + 1))
    for i, d in enumerate(docs[:16]):
        x[i, d], x[i, size] = ratio[d] / math.sqrt(len(d)), 1
    primal = lambda w: w @ w / 2 + np.maximum(0, 1 - labels * (x @ w)).sum()
    gram, alpha = (x * labels[:, None]) @ (x * labels[:, None]).T, np.zeros(16)
    for _ in range(20_000):  # projected gradient ascent of the dual
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, 1)
    dual = alpha.sum() - alpha @ gram @ alpha / 2
    assert dual - 1e-6 <= primal(np.r_[weights, bias]) <= dual + 1e-2 * max(1, dual)


def test_scores_follow_from_the_model(spark):
    model = quality.Model(np.random.default_rng(1).normal(size=1 << quality.BUCKET_BITS).astype(np.float32), 0.3, 1.5, -0.2)
    texts = ["", None, "one", "one two", "two one two", "x " * 5000, "Ünï ñandú"]
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["own"] for r in quality.score(rows, model, out="own").collect()}
    for i, t in enumerate(texts):
        own = quality.features(next(blocks.slices(pa.array([t or ""]))))[1]
        margin = float(model.weights[own].astype(np.float64).sum()) / math.sqrt(max(1, sum(map(len, plain_features(t or ""))))) + 0.3
        assert abs(got[i] - 1 / (1 + math.exp(-(1.5 * margin - 0.2)))) < 1e-9


def test_quality_with_repeated_ids_and_clashing_names(spark):
    rows = [(i % 30, " ".join(random.Random(i).choices(WORDS[:60] if i % 30 % 2 else WORDS[60:120], k=40))) for i in range(120)] + [(None, "w1 w2"), (None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    table = frame(spark, rows).withColumns({"score": F.lit("s"), "score_": F.lit("t"), "quality": F.lit("q"), "id": F.lit("i")})
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns
    want = {(r["doc_id"], r["text"]) for r in quality.score(table, quality.train(table, labels), out="own").where(F.col("own") >= 0.3).collect()}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == want and 0 < len(want) < len(set(rows))
    assert quality.keep_good(table.limit(0), labels).count() == 0


def test_mixing(spark):
    rows = [(i, "x" * (1 + i * 37 % 400)) for i in range(400)] + [(1000, None), (1001, "")]
    got = mixing.mix(frame(spark, rows), block_chars=500).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    slots = {}
    for r in got:
        assert slots.setdefault(r["mix_slot"], (r["source"], r["mix_block"])) == (r["source"], r["mix_block"])
    weights = spark.createDataFrame([(None, 3.0), ("s0", 1.0), ("s1", -1.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mix(frame(spark, rows), weights, block_chars=500).collect()} == {None, "s0"}
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    assert "mix_slot_" in mixing.mix(frame(spark, rows[:3]).withColumn("mix_slot", F.lit("x"))).columns


def earliest_deadlines(blocks: dict[str, int], parts: dict[str, int]) -> list[tuple]:
    """The schedule by the definition, in fractions: (source, block, release, deadline, phase) of every slot."""
    left, out, number = dict(blocks), [], Counter()
    phase = start = 0
    done: Counter = Counter()
    while any(left.values()):
        weight = {s: Fraction(parts[s], sum(parts[x] for x in left if left[x])) for s in left if left[s]}
        at = len(out) - start
        able = [(math.ceil((done[s] + 1) / w), s) for s, w in weight.items() if math.floor(done[s] / w) <= at]
        deadline, s = min(able)
        out.append((s, number[s], start + math.floor(done[s] / weight[s]), start + deadline, phase))
        assert at < deadline
        done[s], left[s], number[s] = done[s] + 1, left[s] - 1, number[s] + 1
        assert all(abs(done[x] - (at + 1) * w) < 1 for x, w in weight.items())
        if not left[s]:
            phase, start, done = phase + 1, len(out), Counter()
    return out


@pytest.mark.parametrize("chars", [{"a": 100, "b": 4900, "c": 40000, "d": 1}, {f"s{i:02}": 60 * (i + 1) ** 2 for i in range(40)}, {"only": 5}, {"x": 10_000, "y": 10_000, "z": 10_000}])
@pytest.mark.parametrize("weighted", [False, True])
def test_schedule_follows_the_definition(spark, chars, weighted):
    names = sorted(chars)
    given = {s: 1 / (i + 3) for i, s in enumerate(names)} if weighted else {s: math.sqrt(n) for s, n in chars.items()}
    weights = spark.createDataFrame([*given.items(), ("absent", 2.0)], "source string, weight double") if weighted else None
    got = mixing.schedule(spark.createDataFrame(list(chars.items()), "source string, chars long"), weights, 100).orderBy("slot").collect()
    parts = {s: max(1, round(given[s] / sum(given.values()) * mixing.PARTS)) for s in names}
    want = earliest_deadlines({s: -(-chars[s] // 100) for s in names}, parts)
    assert [r["slot"] for r in got] == list(range(len(want)))
    assert all(abs(r["weight"] - given[r["source"]] / sum(given.values())) < 1e-9 for r in got)
    near = [(r["source"], r["block"], r["phase"]) for r in got]
    assert near == [(s, b, p) for s, b, _, _, p in want] and all(abs(r["release"] - w[2]) + abs(r["deadline"] - w[3]) == 0 for r, w in zip(got, want, strict=True))


def test_schedule_of_many_blocks_keeps_to_the_weights(spark):
    chars = {"hot": 90_000_000, **{f"s{i}": 9_000_000 + 7919 * i for i in range(11)}}
    got = mixing.schedule(spark.createDataFrame(list(chars.items()), "source string, chars long"), block_chars=1000).where("phase = 0").orderBy("slot").collect()
    weight = {s: n**0.5 / sum(x**0.5 for x in chars.values()) for s, n in chars.items()}
    done = Counter()
    assert len(got) > 100_000
    for t, r in enumerate(got, 1):
        done[r["source"]] += 1
        assert r["release"] <= r["slot"] < r["deadline"]
        assert all(abs(done[s] - t * w) < 1 + 1e-6 for s, w in weight.items())


def test_blocks_grow_where_the_schedule_would(spark):
    sizes = spark.createDataFrame([("a", 10**13), ("b", 3)], "source string, chars long")
    size = mixing.block_size(sizes)
    assert size == -(-(10**13 + 3) // mixing.MOST_BLOCKS) and -(-(10**13) // size) <= mixing.MOST_BLOCKS
    assert mixing.block_size(sizes.limit(0)) == mixing.BLOCK_CHARS


def test_warc(spark):
    big = "ü" * 700
    rows = [(1, "u1", big), (2, "u\r\n2", big), (3, None, "x" * 999), (4, "u4", "x" * 999), (5, "u5", None), (6, "u6", ""), (7, "u7", big + "!"), (7, "u7", big + "!")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        first = max(j for j, _, o in rows if (o or "").encode() == raw)
        revisit = len(raw) >= 1000 and first != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_revisits_name_their_response():
    digest = hashlib.sha1(b"x" * 1000).hexdigest()
    heads = [dict(line.split(": ", 1) for line in gzip.decompress(warc.record(i, "u", b"x" * 1000, digest, first)).decode().split("\r\n\r\n")[0].split("\r\n")[1:]) for i, first in ((1, 2), (2, None), (3, 2))]
    assert heads[0]["WARC-Refers-To"] == heads[2]["WARC-Refers-To"] == heads[1]["WARC-Record-ID"] and len({h["WARC-Record-ID"] for h in heads}) == 3
    assert warc.record(2, "u", b"x", digest, None) == warc.record(2, "u", b"x", digest, None)


def test_zip64(tmp_path):
    import zipfile

    import pyarrow.fs as pafs

    with zipfile.ZipFile(tmp_path / "z.wacz", "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(warc.DATA), "w", force_zip64=True) as f:
            f.write(member := warc.record(5, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None))
        z.writestr(warc.INDEX, f'u 1 {{"filename": "data.warc.gz", "offset": "0", "length": "{len(member)}"}}')
        for i in range(70_000):  # more members than the plain end record can count
            z.writestr(f"x/{i}", b"")
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "z.wacz")) as source:
        package = warc.Package(source)
        assert len(package.members) == 70_002
        assert [r["payload"] for r in package.records()] == [b"hello"]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.06, 0.2])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3 if i % 50 else None))
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None, 1.0], 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [float("inf")] * 16, 1)]
    frame_ = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    got = {r["vec_id"]: r for r in multi_index.near_vectors(frame_).collect()}
    good = [(i, np.array(v, np.float64), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    true = found = 0
    for i, v, y in good:
        n = sum(j != i and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98 for j, w, z in good)
        assert got[i]["n_links"] <= n
        true, found = true + n, found + got[i]["n_links"]
    assert len(got) == len(rows) and found >= 0.9 * true > 0
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (0, 500, 501, 502, 503, 504, 507))
    assert got[506]["component_id"] == 505 and got[505]["n_links"] == 1
    assert multi_index.near_vectors(frame_.limit(0)).count() == 0
