import re

from cases import PERSON, frame, rows_of, sample
from healthwatch.llm import pii

KEY = b"test key"
TEXT = ("Mail ann.19@mail5.example.com or ANN.19@MAIL5.EXAMPLE.COM, bob.20@mail5.example.com, call +1 (499) 555-6503 or 8.196.197.208. "
        "Card 4418452524842581 id 953709720. Mr. John Smith met Mrs Anna Lee and Г-жа Анна Иванова. Mr. John Smith left.")


def test_entities_and_formats():
    made, counts = pii.replace(TEXT, KEY)
    assert counts == {"email": 3, "phone": 1, "ip": 1, "card": 1, "number": 1, "name": 4}
    for private in ("ann.19", "ANN.19", "mail5", "555-6503", "8.196.197.208", "4418452524842581", "953709720", "John", "Smith", "Anna", "Анна", "Иванова"):
        assert private not in made
    found = pii.find(made)
    assert [f[2] for f in found] == [f[2] for f in pii.find(TEXT)]                  # types are kept
    card = next(c for _, _, k, c in found if k == "card")
    assert len(card) == 16 and pii.luhn(card)
    assert "+1 (" in made and found[0][3] == found[1][3] and found[0][3] != found[2][3]      # one person, one surrogate
    assert found[0][3].split("@")[1] == found[2][3].split("@")[1]                             # one domain, one surrogate
    names = [made[s:e] for s, e, k, _ in found if k == "name"]
    assert names[0] == names[3] and all("а" <= c.lower() <= "я" for c in names[2].replace(" ", ""))
    assert pii.replace(TEXT, b"other")[0] != made and pii.replace(TEXT, KEY)[0] == made
    assert pii.replace("No data here, 12 boats.", KEY)[0] == "No data here, 12 boats."


def test_collisions_are_resolved(spark, monkeypatch):
    """A draw space of 3 for 3 entities: all collide at some point."""
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, c, attempt=0: str(hash((c, attempt)) % 7 + 100))
    entities = [("number", str(i)) for i in range(4)]
    drawn = {c: 0 for _, c in entities}
    owner = {}
    while True:
        made = {c: pii.surrogate(KEY, "number", c, a) for c, a in drawn.items()}
        owner = {}
        for c in sorted(made):
            owner.setdefault(made[c], c)
        again = [c for c in made if owner[made[c]] != c]
        if not again:
            break
        for c in again:
            drawn[c] += 1
    assert len(set(made.values())) == 4


def test_assigned_surrogates_are_distinct(spark):
    entities = spark.createDataFrame([("ip", f"10.0.{i // 250}.{i % 250}") for i in range(2000)] + [("number", str(100_000_000 + i)) for i in range(500)],
                                     "kind string, canonical string")
    drawn = pii.assign(entities, KEY).collect()
    originals = {(r["kind"], r["canonical"]) for r in drawn}
    assert len(drawn) == 2500 and len({(r["kind"], r["made"]) for r in drawn}) == 2500
    assert not originals & {(r["kind"], r["made"]) for r in drawn}


def test_later_mentions_and_parts_of_a_name():
    text = ("Mr. John Smith came. John Smith said that Smith's car, JOHN, Smith-based. Mr Smith left. Mrs Anna Lee and Herr J. R. Weber met Lee; "
            "Mr Paul Adam Stone. Stone I. The end. blacksmith Smithson")
    made, counts = pii.replace(text, KEY)
    for private in ("John", "JOHN", "Smith ", "Smith'", "Smith-", "Anna", "Lee", "Weber", "J. R.", "Paul", "Adam", "Stone"):
        assert private not in made
    assert made.endswith("The end. blacksmith Smithson") and counts["name"] == 11
    first, last = made.split("Mr. ")[1].split(" ")[:2]
    assert made.startswith(f"Mr. {first} {last} came. {first} {last} said that {last}'s car, {first.upper()}, {last}-based. Mr {last} left.")
    two, _ = pii.replace("Mr Smith. Mrs Smith. Smith. Mr Smith, Smith", KEY)
    him, her = two.split("Mr ")[1].split(".")[0], two.split("Mrs ")[1].split(".")[0]
    assert him != her and two == f"Mr {him}. Mrs {her}. {her}. Mr {him}, {him}"
    for name, low, high in pii.RANGES:
        word = "Mr " + {"cyrillic": "Иван", "greek": "Νίκος", "hebrew": "דוד", "arabic": "محمد", "armenian": "Արամ", "georgian": "გიორგი",
                        "han": "王伟", "hangul": "민수", "kana": "タロウ"}[name]
        changed = pii.replace(word, KEY)[0]
        assert changed != word and all(pii._script(c) == name for c in changed[3:])


def test_national_phones_and_country_codes():
    for text, pattern in (("555-123-4567", r"[2-9]\d\d-\d{3}-\d{4}"), ("(020) 7946 0958", r"\(0[2-9]\d\) \d{4} \d{4}"), ("(555) 123-4567", r"\([2-9]\d\d\) \d{3}-\d{4}"),
                          ("1-555-123-4567", r"1-[2-9]\d\d-\d{3}-\d{4}"), ("020 7946 0958", r"0[2-9]\d \d{4} \d{4}"), ("0171/1234567", r"0[2-9]\d\d/\d{7}"),
                          ("01 23 45 67 89", r"0[2-9] \d\d \d\d \d\d \d\d"), ("555.123.4567", r"[2-9]\d\d\.\d{3}\.\d{4}"), ("0049 30 123456", r"0049 [2-9]\d \d{6}"),
                          ("+49 30 1234 5678", r"\+49 [2-9]\d \d{4} \d{4}"), ("+1 (499) 555-6503", r"\+1 \([2-9]\d\d\) \d{3}-\d{4}"), ("+353 1 234 5678", r"\+353 [2-9] \d{3} \d{4}")):
        made, counts = pii.replace(f"Call {text}.", KEY)
        assert counts["phone"] == sum(counts.values()) == 1 and text not in made and re.fullmatch(f"Call {pattern}\\.", made), (text, made)
    for text in ("on 01.02.2024 12:30", "01/02/2024 12:30", "2024-01-02 03:04", "100 200 3000", "0.5 and 3.14159", "1 (2019) and (12) 34"):
        assert pii.replace(text, KEY)[0] == text


def test_parts_agree_across_documents(spark):
    rows = [(1, "Mr John Smith. Smith"), (2, "Mr Smith"), (3, "Mr John Doe")]
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(spark.createDataFrame(rows, "doc_id bigint, text string"), KEY).collect()}
    first, last = got[1].removeprefix("Mr ").split(".")[0].split(" ")
    assert got[1].endswith(f". {last}") and got[2] == f"Mr {last}" and got[3].startswith(f"Mr {first} ")


def test_small_spaces_of_draws_do_not_run_out(spark):
    """More names, addresses and domains than surrogates of the first shape."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [("name", f"m:latin:{a}{b}{c}q") for a in letters for b in letters for c in letters][:10_000]
    emails = [("email", f"{a}@x{b}.co") for a in letters for b in letters] + [("email", f"a{a}@{b}.co") for a in letters for b in letters] + [("email", "_@-.co")]
    phones = [("phone", f"1{i:04}") for i in range(9_000)]
    rows = names + emails + phones
    drawn = pii.assign(spark.createDataFrame(rows, "kind string, canonical string"), KEY).collect()
    made = {(r["kind"], r["canonical"]): r["made"] for r in drawn}
    assert len(drawn) == len(made) == len(rows) and len({(k, m) for (k, _), m in made.items()}) == len(rows)
    assert not set(rows) & {(k, m) for (k, _), m in made.items()}
    moved = {}
    for (kind, c), m in made.items():
        if kind == "email":
            moved.setdefault(c.split("@")[1], set()).add(m.split("@")[1])
    assert all(len(x) == 1 for x in moved.values()) and len(set.union(*moved.values())) == len(moved)
    assert all(r["made"] == pii.surrogate(KEY, r["kind"], r["canonical"], r["attempt"], r["domain_attempt"]) for r in drawn)


def test_redrawn_surrogates_reach_the_documents(spark):
    """Single-letter domains collide; every address must still get its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(f"a@{b}.co" for b in letters)
    for r in pii.surrogates(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string"), KEY).collect():
        assert len(set(r["text"].split())) == 26 and not set(text.split()) & set(r["text"].split()) and r["n_email"] == 26


def test_operator(spark):
    for df in (frame(spark), sample(spark)):
        got = sorted((str(r["doc_id"]), r["n_entities"], r["text"]) for r in pii.surrogates(df, KEY).collect())
        want = sorted((str(i), len(pii.find(t)), pii.replace(t or "", KEY)[0]) for i, t in rows_of(df))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert sum(g == w for g, w in zip(got, want)) >= len(got) - 1              # only collisions may differ
    person = [r for r in pii.surrogates(frame(spark), KEY).collect() if r["doc_id"] == 9][0]
    first, second = person["text"].split("\n")
    assert first == second and first != PERSON                                     # coreference inside and across documents
    assert pii.surrogates(frame(spark, [])).count() == 0
