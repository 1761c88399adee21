"""Mixing, line removal and pseudonyms."""

import hashlib
from collections import Counter

import pytest
from sample_texts import prose
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, mixing, pseudonyms

# mixing


def sums(spark, sizes, weights=None):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r.source: r.target for r in mixing.targets(mixing.ranked_weights(table)).collect()}


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    cut = set()
    while True:
        free = [s for s in sizes if s not in cut]
        rest, w = total - sum(2.0 * sizes[s] for s in cut), sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in cut else rest * weight[s] / w for s in sizes}
        above = {s for s in free if target[s] > 2.0 * sizes[s]}
        if not above:
            return target
        cut |= above


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 5, "b": 500, "c": 40, None: 7}, {"a": 0, "b": 0}, {"a": 0, "b": 9}, {f"s{i}": (i * 37) % 101 for i in range(40)}])
def test_targets(spark, sizes):
    got, want = sums(spark, sizes), plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_comes_near_its_targets_and_repeats(documents):
    rows = [(i, prose(i, 5 + i % 50), ["hot", "a", "b", None][0 if i % 3 == 0 else i % 4]) for i in range(3000)]
    df = documents(rows, extra=True)
    got = mixing.counted(df).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert r.copies <= 2 and r.size == 5 + r.id % 50
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)
    out = mixing.mixed(df)
    assert out.columns[:-1] == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.id: r.copies for r in got if r.copies})


def test_mixing_of_odd_rows(documents):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 100_000, "a"), (3, "\x0b \t\r\n", None)]
    got = sorted((r.id or 0, r.size, r.source_size) for r in mixing.counted(documents(rows)).collect())
    assert got == [(0, 0, 0), (1, 0, 100_000), (1, 0, 100_000), (2, 100_000, 100_000), (3, 0, 0)]
    assert mixing.counted(documents([])).count() == 0 == mixing.mixed(documents([])).count()


# lines


def plain_lines(rows):
    """Lines of 21 words or more are spread from two sites on, of 4 from three, shorter ones from six."""
    sites, first = {}, {}
    least = lambda line: 2 if len(line.split()) >= 21 else 3 if len(line.split()) >= 4 else 6
    cut = lambda t: (t or "").split("\n")
    for i, t, s in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for p, line in enumerate(cut(t)):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line:
                sites.setdefault(line, set()).add(s)
                first.setdefault(line, (i, p))
    out = {}
    for i, t, _ in rows:
        keep = [x for p, x in enumerate(cut(t)) if not x.strip(" \t\x0b\x0c\r") or len(sites[x.strip(" \t\x0b\x0c\r")]) < least(x) or first[x.strip(" \t\x0b\x0c\r")] == (i, p)]
        out[i] = None if t is None else "\n".join(keep)
    return out


def test_spread_lines_stay_once(documents):
    rows = [(i, f"{prose(i)}\n  common line of all \n\nalso {i % 2}\ncommon line of all", ["a", "b", "c", None][i % 4]) for i in range(40)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "common line of all", "c"), (103, "\n".join(f"line {k % 7}" for k in range(20_000)), "a"), (104, "line 3", "b"), (105, "line 3", "c")]
    words = " ".join(f"w{k}" for k in range(21))
    rows += [(200, f"{words}\n{words[:-4]}", "a"), (201, f"x\n{words[:-4]}\n  {words}", "b"), (202, f"{words} {words}", "d"), (203, f"{words} {words}", "d")]
    rows += [(300 + k, f"three short words\nof five sites\n{prose(300 + k)}", f"s{min(k, 5 - k % 2)}") for k in range(9)]
    df = documents(rows, extra=True)
    out = line_dedup.cleaned(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    want = plain_lines(rows)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] == (None if v[0] is None else len(v[0])) for v in got.values())


def test_many_sites_and_near_threshold(documents):
    rows = [(i, f"everywhere\nat {i // 2}", f"site{i}") for i in range(300)]
    got = line_dedup.cleaned(documents(rows), report=True, min_sites=100).collect()
    assert Counter(r.n_removed for r in got) == Counter({1: 299, 0: 1})
    got = line_dedup.cleaned(documents(rows), report=True, min_sites=2).collect()
    assert sum(r.n_removed for r in got) == 299 + 150


def test_lines_of_repeated_rows_and_empty_table(documents):
    rows = [(None, "a b c d", "x"), (None, "a b c d", "y"), (5, "a b c d", "z"), (5, "a b c d", "z")]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.cleaned(documents(rows)).collect())
    assert got == [(0, ""), (0, ""), (5, "a b c d"), (5, "a b c d")]
    assert line_dedup.cleaned(documents([])).count() == 0


# pseudonyms


def changed(documents, *texts, key="k"):
    df = documents([(i, t, "a") for i, t in enumerate(texts)], extra=True)
    out = pseudonyms.pseudonymised(df, key)
    assert out.columns[:-1] == df.columns
    return [(r.text, r[-1]) for r in out.orderBy("doc_id").collect()]


def luhn(x):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(x[::-1])) % 10 == 0


def test_numbers_keep_their_format_and_stay_linked(documents):
    card, iban = "4539 5787 6362 1486", "DE89 3704 0044 0532 0130 00"
    (one, found), (two, _) = changed(documents, f"card {card}, {iban}; born 1987-02-28.", f"{iban} and 4539578763621486 on 28.02.1987")
    new = {r.kind: r.pseudonym for r in found}
    assert one == f"card {new['card']}, {new['iban']}; born {new['date']}." and one != two
    assert luhn(new["card"].replace(" ", "")) and new["card"] != card and [len(x) for x in new["card"].split()] == [4, 4, 4, 4]
    flat = new["iban"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    y, m, d = new["date"].split("-")
    assert two == f"{new['iban']} and {new['card'].replace(' ', '')} on {d}.{m}.{y}"
    assert changed(documents, card, key="other")[0][0] != new["card"]


def test_values_that_fail_their_check_stay(documents):
    text = "4539578763621487 1987-02-30 31/31/1987 300.1.1.1 1.2.3.4.5 000-12-3456 DE00370400440532013000 v1.2 2024"
    assert changed(documents, text, None, "", "x" * 200_000, "1" * 100_000) == [(text, []), (None, []), ("", []), ("x" * 200_000, []), ("1" * 100_000, [])]


def test_mail_phone_and_address(documents):
    text = "Call +1 (017) 555-7713 or mail ann.lee@mail.example.com at 10.0.0.1."
    out, found = changed(documents, text)[0]
    assert [r.kind for r in found] == ["phone", "email", "ipv4"]
    assert not any(v in out for v in ("555-7713", "ann.lee", "10.0.0.1")) and out.startswith("Call +1 (")
    assert changed(documents, text, text)[0] == changed(documents, text, text)[1]


def test_permutations(spark):
    digits = spark.range(1000).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("p"))
    assert {r.p for r in digits.collect()} == {f"{i:03d}" for i in range(1000)}
    pair = pseudonyms.feistel(F.floor(F.col("id") / 773), F.pmod("id", F.lit(773)), (F.lit(189).cast("long"), F.lit(773).cast("long")), "k", "date")
    assert spark.range(146_097).select(pair.alias("p")).distinct().count() == 146_097


def plain_feistel(left, right, sizes, key, kind):
    for turn in range(pseudonyms.ROUNDS):
        half, size = (right, sizes[0]) if turn % 2 == 0 else (left, sizes[1])
        step = int(hashlib.md5(f"{key}:{kind}:{turn}:{half}:{size}".encode()).hexdigest()[:15], 16)
        if turn % 2 == 0:
            left = (left + step) % sizes[0]
        else:
            right = (right + step) % sizes[1]
    return left, right


def plain_digits(digits, key, kind):
    n = len(digits) // 2
    left, right = plain_feistel(int(digits[:n]), int(digits[n:]), (10**n, 10 ** (len(digits) - n)), key, kind)
    return f"{left:0{n}d}{right:0{len(digits) - n}d}"


def test_social_numbers_stay_valid_and_distinct(documents):
    areas = [a for a in range(1, 900) if a != 666]
    old = [(areas[(i * 37) % 898], i % 99 + 1, i * 7919 % 9999 + 1) for i in range(9_990)]
    old += [(1, 1, 1), (665, 99, 9999), (667, 1, 1), (899, 99, 9999)]
    old = list(dict.fromkeys(old))
    out = changed(documents, " ".join(f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in old))[0][0].split(" ")
    want = []
    for a, g, s in old:
        left, right = plain_feistel(areas.index(a) * 99 + g - 1, s - 1, pseudonyms.SSN_SIZES, "k", "ssn")
        want.append(f"{areas[left // 99]:03d}-{left % 99 + 1:02d}-{right + 1:04d}")
    assert out == want and len(set(out)) == len(old) > 9_900
    assert all(x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000" for x in out)


def test_one_pseudonym_for_every_writing_of_a_phone_number(documents):
    ways = ["+1 555 123 4567", "+15551234567", "(555) 123-4567", "555.123.4567", "+1 (555) 123-4567", "+1-555-123-4567"]
    out = [text for text, _ in changed(documents, *ways)]
    new = plain_digits("5551234567", "k", "phone+1")
    assert {"".join(c for c in x if c.isdigit())[-10:] for x in out} == {new} and new != "5551234567"
    assert [x[:2] for x in out if x[0] == "+"] == ["+1"] * 4 and out[2][0] == "("
    more = ["+44 20 7946 0958", "+442079460958", "+351 21 123 4567", "+49 30 123456"]
    got = [text for text, _ in changed(documents, *more)]
    assert got[0].replace(" ", "") == got[1] == "+44" + plain_digits("2079460958", "k", "phone+44")
    assert got[2].replace(" ", "") == "+351" + plain_digits("211234567", "k", "phone+351") and got[3].startswith("+49 ")


def test_pseudonyms_of_empty_table(documents):
    assert pseudonyms.pseudonymised(documents([]), "k").count() == 0


def test_chance_is_the_digest(documents):
    row = documents([(5, "some text", "a")]).select(mixing.chance(F.col("doc_id"), F.col("text")).alias("u")).first()
    assert row.u == int(hashlib.md5(b"mix-1:5:some text").hexdigest()[:12], 16) / 16**12
