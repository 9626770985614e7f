import random
import re

from pyspark.sql import functions as F

from paperloom.llm import pii
from paperloom.llm.pii import replaced


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


DOCS = [
    (1, "Mail anna.Lee@Mail5.example.com or +1 (743) 555-3824 now, from 70.23.22.57."), (2, "again ANNA.lee@mail5.example.com, +1 743 555 3824; 4111 1111 1111 1111!"),
    (3, 'x token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" y 4111111111111111 and 4785380592391139'), (4, None), (5, ""), (6, "clean text, 12 apples on 2024-01-05 v1.2.3"),
    (7, "Mrs Mary Jones met Mr. Smith and Мария Иванова; ANNA SMITH"), (None, "SSN 123-45-6789, IBAN DE44 5001 0517 5407 3249 31."), (6, "clean text, 12 apples on 2024-01-05 v1.2.3"),
]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "v", 1) for r in rows], "doc_id bigint, text string, kind string, attempt int")
    return replaced(df, **kw)


def test_formats_and_coreference(spark):
    got = run(spark, DOCS).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(DOCS) and by[4].text is None and by[5].text == "" and by[6].text == DOCS[5][1] and by[6].n_entities == 0
    one = re.fullmatch(r"Mail ([a-z]{4}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}[0-9]\.[a-z]{7}\.com) or \+1 \(([0-9]{3})\) ([0-9]{3})-([0-9]{4}) now, from ([0-9.]+)\.", by[1].text)
    two = re.fullmatch(r"again ([A-Z]{4}\.[a-z]{3}@\S+), \+1 ([0-9]{3}) ([0-9]{3}) ([0-9]{4}); ([0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4})!", by[2].text)
    assert one and two, (by[1].text, by[2].text)
    assert one[1].lower() == two[1].lower() and one.groups()[1:4] == two.groups()[1:4]
    assert "anna" not in by[1].text.lower() and one[2] + one[3] + one[4] != "7435553824" and one[5] != "70.23.22.57"
    cards = re.findall(r"[0-9]{16}", by[3].text)
    assert cards[0] == two[5].replace(" ", "") and luhn(cards[0]) and cards[0][0] == "4" and luhn(cards[1]) == luhn("4785380592391139")
    secret = re.search(r'token = "([0-9a-f]{40})" y', by[3].text)[1]
    assert secret != "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"
    names = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+) and (\w+) (\w+); ANNA SMITH", by[7].text)
    assert names and names[1] in pii.GIVEN["f", "latin"].split() and names[4] in pii.GIVEN["f", "cyrillic"].split() and re.match("[Ѐ-ӿ]+$", names[5])
    assert re.fullmatch(r"SSN [0-9]{3}-[0-9]{2}-[0-9]{4}, IBAN DE[0-9]{2} [0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4} [0-9]{2}\.", by[None].text), by[None].text
    assert sorted(map(str, got)) == sorted(map(str, run(spark, DOCS).collect()))
    assert by[1].text != {r.doc_id: r for r in run(spark, DOCS, key="other").collect()}[1].text
    assert run(spark, DOCS).limit(0).count() == 0 and run(spark, DOCS[:1]).limit(0).count() == 0


def test_collisions_keep_values_apart(spark, monkeypatch):
    rows = [(i, f"from {i}.1.1.1 or a{i}@b.io, {100 + i // 100}-{10 + i % 90}-{i:04d}") for i in range(1, 250)]
    rows += [(i + 1000, f"Mr. {n} Smith{chr(97 + i % 26)}") for i, n in enumerate(pii.GIVEN["m", "latin"].split() * 20)]
    for inline in (500, 0):
        monkeypatch.setattr(pii, "INLINE", inline)
        monkeypatch.setattr(pii, "SYLLABLES", {"latin": "ba del", "cyrillic": "ба дел"})
        got = {r.doc_id: r.text for r in run(spark, rows).collect()}
        seen = {}
        for i, text in rows:
            assert got[i] != text
            assert seen.setdefault(got[i], text) == text, (text, seen[got[i]])


def test_left_boundaries(spark):
    """A secret's key word after '_', '-', '.' or a letter, and e-mails and IBANs right after letters that are not ASCII."""
    texts = [
        "x client_secret=abcdefghij0123456789 y", "access_token: 2321bac4d15ec8f90433955bf9d3cf61", "export DB_PASSWORD=Abcdefgh12345678", "cfg.api-key='abcdefghij0123456789'", "mytoken=abcdefghij0123456789",
        "邮箱anna.lee@mail.com", "почтаanna.lee@mail.com", "账号DE44500105175407324931AB!", "_Mr. Smith",
    ]
    got = {r.doc_id: r for r in run(spark, list(enumerate(texts))).collect()}
    gone = ["abcdefghij0123456789", "2321bac4", "Abcdefgh12345678", "abcdefghij0123456789", "abcdefghij0123456789", "anna.lee", "anna.lee", "500105175407324931", "Smith"]
    for i, (text, value) in enumerate(zip(texts, gone)):
        assert got[i].n_entities == 1 and value not in got[i].text, (text, got[i].text)
    assert got[0].text.startswith("x client_secret=") and got[2].text.startswith("export DB_PASSWORD=") and got[5].text.startswith("邮箱") and got[5].text.endswith(".com")
    plain = ["Armrs Smith", "xMr. Smith", "XDE44500105175407324931AB"]
    assert [r.text for r in run(spark, list(enumerate(plain))).orderBy("doc_id").collect()] == plain


def test_ibans_are_taken_whole(spark):
    """Lengths that are no multiple of four, compact and spaced; what follows one stays."""
    whole = [
        "DE89370400440532013000", "NL91ABNA0417164300", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NO9386011117947", "MT84MALT011000012345MTLCAST001S",
        "XX12345678901234", "XX12ABCD5678ABCD56", "XX12" + 3 * "3456789012", "PL61109010140000071219812874", "DE441234567890123456",
    ]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in whole]
    rows = [(i, f"to {x}.") for i, x in enumerate(whole + spaced)] + [(100, "PL61 1090 1014 0000 0712 1981 2874 EUR 500"), (101, "DE44 5001 0517 5407 3249 31 BIC"), (102, "XX12 3456 7890 1234 5678 EUR")]
    got = {r.doc_id: r for r in run(spark, rows).collect()}
    for i, x in enumerate(whole + spaced):
        new = got[i].text[3:-1]
        assert got[i].n_entities == 1 and got[i].text[:5] == "to " + x[:2] and got[i].text[-1] == ".", got[i].text
        assert [(c.isdigit(), c.isupper(), c == " ") for c in new] == [(c.isdigit(), c.isupper(), c == " ") for c in x]
        assert new != x and got[i % len(whole)].text == got[i].text.replace(" ", "").replace("to", "to ")
    # over all of them, the last group is drawn anew like the rest
    assert sum(got[i].text[3:-1].split()[-1] != x.split()[-1] for i, x in enumerate(spaced, len(whole))) >= len(whole) - 2
    new = got[8 + len(whole)].text[3:-1].replace(" ", "")
    assert sum(a == b for a, b in zip(new[2:], whole[8][2:])) < 12
    assert got[100].text.endswith(" EUR 500") and got[101].text.endswith(" BIC") and got[102].text.endswith(" EUR") and all(got[i].n_entities == 1 for i in (100, 101, 102))


def test_phones_end_where_the_next_entity_starts(spark):
    phones = ["+1 (826) 555-4081", "+18265554081", "+49 30 1234 5678", "+44 20 7946 0958"]
    others = ["190.137.223.204", "4111 1111 1111 1111", "123-45-6789", "(743) 555-3824", "+1 (843) 555-7672"]
    rows = [(100 * i + j, f"{a} {b} end") for i, a in enumerate(phones) for j, b in enumerate(others)]
    rows += [(1000, "+1 (826) 555-4081 190 apples"), (1001, "+1 (826) 555-4081.5"), (1002, "+44 20 7946 0958 2024"), (1003, "+49 170 123 4567 89")] + [(2000 + i, a) for i, a in enumerate(phones)]
    got = {r.doc_id: r for r in run(spark, rows).collect()}
    for i, a in enumerate(phones):
        for j, b in enumerate(others):
            out = got[100 * i + j]
            assert out.n_entities == 2 and out.text.startswith(got[2000 + i].text + " ") and out.text.endswith(" end"), out.text
            kept = out.text[len(a) + 1 : -4].split(".") if j == 0 else None
            assert kept is None or (len(kept) == 4 and kept != b.split(".")), out.text
            assert a not in out.text and b not in out.text
    assert got[1000].text == got[2000].text + " 190 apples" and got[1001].text == got[2000].text + ".5" and got[1002].text == got[2003].text + " 2024"
    assert got[1003].n_entities == 1 and len(got[1003].text) == 19


def test_planted_entities_are_replaced_and_nothing_else(spark):
    """Texts around planted values come out as they were; each value has one surrogate, and no two have the same."""
    draw = random.Random(1)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    makers = {
        "email": lambda: f"{pick(lower, 2)}@{pick(lower, 4)}.co.uk", "phone": lambda: f"+1 ({draw.randrange(200, 1000)}) {draw.randrange(100, 1000)}-{pick(digits, 4)}",
        "ip": lambda: ".".join(str(draw.randrange(256)) for _ in range(4)), "ipv6": lambda: f"2001:db8:{draw.randrange(16**4):x}::{draw.randrange(16**4):x}", "ssn": lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        "aws": lambda: "AKIA" + pick(upper + digits, 16), "token": lambda: "ghp_" + pick(lower + digits, 36), "name": lambda: f"{draw.choice(['Bob', 'Jessica', 'Mary'])} {pick(upper, 1)}{pick(lower, 5)}",
        "label": lambda: f"{pick(upper, 1)}{pick(lower, 4)} {pick(upper, 1)}{pick(lower, 6)}", "street": lambda: f"{draw.randrange(1, 9999)} {pick(upper, 1)}{pick(lower, 5)} Street", "birth": lambda: f"{draw.randrange(1, 29):02}/{draw.randrange(1, 13):02}/{draw.randrange(1930, 2010)}",
    }
    before = {"label": "name: ", "birth": "born on "}
    fillers = ["the cat sat,", "a lot of 12 apples;", "see page 7 of the book:", "und so weiter"]
    rows, planted = [], []
    for i in range(400):
        kinds = draw.sample(sorted(makers), 3)
        values, gaps = [makers[k]() for k in kinds], [" , " + draw.choice(fillers) + " " + before.get(k, "") for k in kinds] + [" and more"]
        planted.append((kinds, values, gaps))
        rows.append((i, "".join(g + v for g, v in zip(gaps, [*values, ""]))))
    rows += [(1000 + i, text) for i, (_, text) in enumerate(rows[:50])]
    got = {r.doc_id: r for r in run(spark, rows).collect()}
    surrogate, missed = {}, []
    for i, (kinds, values, gaps) in enumerate(planted):
        found = re.fullmatch("(.+?)".join(map(re.escape, gaps)), got[i].text)
        assert found, got[i].text
        for kind, value, new in zip(kinds, values, found.groups()):
            if value == new:
                missed.append((kind, value))
            assert surrogate.setdefault((kind, value), new) == new
    assert not missed and len({(k, new) for (k, _), new in surrogate.items()}) == len(surrogate)
    assert all(got[1000 + i].text == got[i].text for i in range(50))


def test_numbers_are_permuted(spark):
    """All numbers of one length: each has another, none is met twice, and a leading zero stays one."""
    for n in (1, 2, 3, 5):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        got = {r.d: (r.a, r.b) for r in df.select("d", pii._number(F.col("d"), F.lit("k")).alias("a"), pii._any_digits(F.col("d"), F.lit("k")).alias("b")).collect()}
        assert {b for _, b in got.values()} == set(got) and all(b != d for d, (_, b) in got.items())
        assert {a for a, _ in got.values()} == set(got) and all((a[0] == "0") == (d[0] == "0") and (a != d or d == "0") for d, (a, _) in got.items())


def test_dense_numbers_and_long_texts(spark):
    numbers = [f"(555) 010-{i:04}" for i in range(10000)] + [f"(555) 011-{i:04}" for i in range(10000)]
    rows = [(i, " ".join(numbers[i * 200 : i * 200 + 200])) for i in range(100)]
    long = ["x@" + "ab." * 200_000, "a." * 500_000 + "@b.io", "1 " * 500_000, "Mr. " * 250_000, "token=" + "k" * 1_000_000, "AA" * 400_000 + "12", "1:" * 300_000, "+1 " * 300_000, "A Street " * 100_000, "----------------"]
    got = {r.doc_id: r for r in run(spark, rows + [(1000 + i, t) for i, t in enumerate(long)] + [(2000, "password=----------------")]).collect()}
    new = [x for i in range(100) for x in re.findall(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", got[i].text)]
    assert len(new) == len(set(new)) == len(numbers) and all(a != b for a, b in zip(new, numbers))
    assert got[1000].n_entities == 1 and got[1004].n_entities == 1 and len(got[1004].text) == 1_000_006 and got[1009].text == "-" * 16
    assert got[2000].text != "password=----------------"


def test_dates_of_birth_become_other_dates_that_exist(spark):
    import datetime

    days = [datetime.date(1980, 1, 1) + datetime.timedelta(days=k) for k in range(3653)]
    patterns = ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d.%m.%Y")
    given = [(k * 10_000 + i, f"born {d.strftime(pattern)}.") for k, pattern in enumerate(patterns) for i, d in enumerate(days) if k != 1 or d.day > 12]
    got = {r.doc_id: r.text[5:-1] for r in pii.replaced(spark.createDataFrame(given, "doc_id bigint, text string")).collect()}
    assert len(set(got.values())) == len(given)
    for at, text in got.items():
        made = datetime.datetime.strptime(text, patterns[at // 10_000]).date()  # raises for what does not exist
        assert made != days[at % 10_000] and made.year // 10 == 198
    odd = pii.replaced(spark.createDataFrame([(1, "born 31/02/1987"), (2, "born 99/99/1987")], "doc_id bigint, text string")).collect()
    assert {r.n_entities for r in odd} == {1} and all("1987" not in r.text and "31/02" not in r.text for r in odd)


def test_titles_family_names_first_short_addresses_and_passports(spark):
    texts = ["Dr. Okonkwo and SMITH John saw Priya Raghavan.", "John Smith", "Аня Петрова", "ping fe80::1 or 2001:db8::ff00", "std::vector and 12::30", "passport no. X1234567, Passport: 123456789", "THE Anna story", "FROM Mary"]
    rows = {r.doc_id: r for r in pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [rows[i].n_entities for i in range(8)] == [3, 1, 1, 2, 0, 2, 0, 0]
    assert rows[0].text.startswith("Dr. ") and not any(w in rows[0].text for w in ("Okonkwo", "SMITH", "John", "Raghavan"))
    family, given = rows[0].text.split(" and ")[1].split(" saw")[0].split(" ")
    assert family.isupper() and rows[1].text == f"{given} {family.capitalize()}"  # the same person, written in another way
    assert "fe80::1" not in rows[3].text and rows[3].text.count("::") == 2 and rows[4].text == texts[4]
    assert "X1234567" not in rows[5].text and rows[5].text[13].isupper()
