"""Operators that judge each row: against plain Python on rows full of trouble."""

import hashlib
import random
import re
import textwrap
from collections import Counter
from datetime import datetime, timedelta
from math import comb, log2
from pathlib import Path

import duckdb
import pytest
import regex

from loomspark.llm import language, licences, pii, quality, secrets, urls
from loomspark.session import checkpointed
from pyspark.sql import functions as F
from tests.llm import nasty

SPACE = " \t\n\x0b\x0c\r"


def plain(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})


def test_quality_counts_match_brute_force(spark):
    docs = nasty.documents(spark)
    got = Counter(tuple(r) for r in quality.features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for doc_id, text, *_ in nasty.rows():
        words, lines = plain(text), [x for x in (text or "").split("\n") if plain(x)]
        want[(doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat_words(words))] += 1
    assert got == want


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 40, 0.05), (12, 5000, 0.004), (700, 180000, 0.004)])
def test_binomial_tail_is_exact(spark, k, n, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first()["x"]
    from fractions import Fraction

    if n <= 5000:
        f = Fraction(p)
        assert got == pytest.approx(float(sum(comb(n, i) * f**i * (1 - f) ** (n - i) for i in range(k + 1))), rel=1e-9)
    else:
        assert 0.2 < got < 0.6


def test_quality_cutoffs_are_proven_and_kept_follows(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + (" #" if i % 500 == 0 else ""), "en") for i in range(3000)]
    bad = [(3000 + i, " ".join(f"###{i}x{j}" for j in range(60)), "en") for i in range(200)]
    few = [(4000, " ".join(f"###q{j}" for j in range(60)), "fr")]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(3000 + i, 0) for i in range(200)] + [(4000, 1), (None, 1), (5, None)], "doc_id long, quality int")
    limits = {(r["lang"], r["rule"]): r for r in quality.cutoffs(checkpointed(quality.features(docs)), labels).collect()}
    assert ("en", "symbols") in limits and all(r["p_value"] <= 0.05 / 2 and r["n_rejected"] <= 0.02 * r["n_good"] for r in limits.values())
    assert ("fr", "symbols") not in limits  # one label proves nothing
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
    assert sum(kept[i] for i in range(3000)) >= 2980 and not any(kept[3000 + i] for i in range(200)) and kept[4000]


def brute_cutoffs(rows, alpha=0.02, delta=0.05):
    """(lang, rule) -> (stratum, cutoff, n_good, n_rejected) in plain Python. rows: lang, part, steps."""
    rules, langs = list(quality.RULES), {r[0] for r in rows}
    need = quality.needed(alpha, delta / (len(langs) + 1))
    own = {x: x if sum(r[0] == x and r[1] == "holdout" for r in rows) >= need else "(other)" for x in langs}
    strata, out = set(own.values()), {}
    for s in strata:
        of = lambda part: [r[2] for r in rows if own[r[0]] == s and r[1] == part]
        bad, tuning, holdout = of("bad"), of("tuning"), of("holdout")
        path = []
        for i in range(len(rules)):
            caught = {c: sum(x[i] > c for x in bad) for c in range(100) if sum(x[i] > c for x in tuning) <= alpha / 2 * len(tuning) and any(x[i] > c for x in bad)}
            for c in {max(c for c, n in caught.items() if n >= q * max(caught.values())) for q in (0.5, 0.9, 0.99)} if caught else ():
                path.append((-max(caught.values()), i, -c))
        path.sort()
        first = Counter(next((i for _, i, c in path if x[i] > -c), None) for x in bad)
        path = [(i, -c) for _, i, c in path if first[i] >= 0.01 * len(bad) and first[i]]
        found = {}
        for n in range(1, len(path) + 1):
            k = sum(any(x[i] > c for i, c in path[:n]) for x in holdout)
            if sum(comb(len(holdout), j) * alpha**j * (1 - alpha) ** (len(holdout) - j) for j in range(k + 1)) > delta / len(strata):
                break
            found[path[n - 1][0]] = path[n - 1][1]
            last = k
        out |= {(x, rules[i]): (s, c, len(holdout), last) for x in langs if own[x] == s for i, c in found.items()}
    return out


def test_quality_cutoffs_match_brute_force(spark):
    import random

    draw, rows = random.Random(11), []
    for lang, n, harm in (("en", 1500, 0.0), ("de", 700, 0.004), ("fr", 150, 0.0), ("es", 140, 0.0), ("xx", 20, 0.0)):
        for good in [True] * n + [False] * (n // 4):
            steps = [draw.choice((0, 0, 1, 2)), draw.choice((1, 2, 3)), draw.choice((0, 0, 0, 20)), draw.choice((0, 1, 5))]
            if not good or draw.random() < harm:
                steps[draw.choice((0, 0, 0, 3))] = draw.randint(8, 60)
            rows.append((len(rows), lang, good, steps))
    counts = [(i, lang, 100, 100, x[0], x[1], 100, x[2], x[3]) for i, lang, _, x in rows]
    df = spark.createDataFrame(counts, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_capitals long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = spark.createDataFrame([(i, int(good)) for i, _, good, _ in rows], "doc_id long, quality int")
    parts = {r["doc_id"]: (r["lang"], r["part"], list(r["steps"])) for r in quality._labelled(df, labels, 0.02, 0.05).collect()}
    got = {(r["lang"], r["rule"]): (r["stratum"], r["cutoff"], r["n_good"], r["n_rejected"]) for r in quality.cutoffs(df, labels).collect()}
    assert got == brute_cutoffs([parts[i] for i, _, _, x in rows if i in parts])
    assert {s for s, *_ in got.values()} >= {"en", "(other)"} and all(c < 60 for _, c, *_ in got.values())


def test_quality_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judged(nasty.empty(spark), labels).count() == 0
    assert quality.judged(nasty.documents(spark), labels).count() == len(nasty.rows())


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base_spans_match_brute_force(spark):
    got = secrets.scanned(nasty.documents(spark)).select("doc_id", F.sha2(secrets.as_text(F.col("base_found")), 256), secrets.as_text(F.col("all_found"))).collect()
    want = Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t)).encode()).hexdigest()) for i, t, *_ in nasty.rows())
    assert Counter((r[0], r[1]) for r in got) == want
    for r in got:
        base = [f"{k}:{a}:{b}" for a, _, b, k in base_spans(nasty.TEXTS[r[0]])] if r[0] is not None and r[0] != 17 else []
        assert [x for x in r[2].split(",") if x and not x.startswith("entropy")] == base


def test_entropy_slides_exactly_and_allow_list_holds(spark):
    values = ["aaaaaaaaaaaaaaaaaaaaaaaaa", "Zx8kQ2mN7pR4tW9vB3cL6yH1", "abababababababababababab", "0123456789abcdefghijklmnop", "Kq9ZbT2xLm4VwR7pYn3Jc8Hd5Gf6"]

    def brute(s, w=20):
        return max((-sum(c / w * log2(c / w) for c in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1)), default=-1)

    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.best_entropy(F.split("v", "")).alias("e"))
    for r in df.collect():
        assert r["e"] == pytest.approx(brute(r["v"]), abs=1e-9)
    texts = [(1, "key Zx8kQ2mN7pR4tW9vB3cL6yH1 end"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, "a/long/path/of/plain/words/2024"), (4, "Donaudampfschifffahrtsgesellschaft"), (5, "2024-01-02-03-04-05-06-07")]
    spans = {r["doc_id"]: r["s"] for r in secrets.scanned(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", secrets.as_text(F.col("all_found")).alias("s")).collect()}
    assert spans == {1: "entropy:4:28", 2: "", 3: "", 4: "", 5: ""}


def brute_scan(text):
    """All spans and the redacted text, in plain Python."""

    def entropy(s):
        return max(-sum(c / 20 * log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))

    def limit(v):
        if not re.search("[A-Za-z]", v):
            return None
        if not re.search("[0-9]", v):
            return secrets.LIMITS["letters"] if re.search("[a-z]", v) and re.search("[A-Z]", v) else None
        return secrets.LIMITS["hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) else "alnum" if re.fullmatch("[A-Za-z0-9]+", v) else "base64"]

    allowed = re.compile(
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9=+/_-]+$|EXAMPLE|[xX]{6,}|0123456789|abcdefghij"
        r"|^[+/_=-]*[A-Za-z]*(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,4})){2,}[+/_=-]*$"
    )
    base = base_spans(text)
    every = list(base)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if limit(m[0]) is not None and not allowed.search(m[0]) and entropy(m[0]) >= limit(m[0]) and not any(a <= m.start() and b >= m.end() for a, _, b, _ in base):
            every.append((m.start(), 3, m.end(), "entropy"))
    every.sort()
    out, at = "", 0
    for a, _, b, _ in every:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in every), out + text[at:] if every else text


def test_texts_full_of_secrets_match_brute_force(spark):
    import random

    draw = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

    def bit(i):
        n = draw.choice((3, 8, 20, 25, 60, 300))
        value = "".join(draw.choice(letters[: draw.choice((4, 16, 62, 67))]) for _ in range(n))
        return draw.choice((f'token = "{value}"', f"secret:{value}", value, f"api_key={value}.token={value}", f"AKIA{value.upper()}", value.lower(), "ébène 🙂 plain words here\n", "a/b/c/2024"))

    texts = ["token=abcdef" * 3, " ".join(f'token = "abc{i:05d}"' for i in range(5000)), "/".join("ab" for _ in range(30000)), "0a" * 40000, "é" * 4096 + "token=abcdefgh" + "🙂" * 4090 + " secret: abcdefgh"]
    texts += [" ".join(bit(i) for i in range(k)) for k in (0, 1, 2, 3, 5, 9, 17, 40, 200, 900)]
    got = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.select("doc_id", "text", secrets.as_text(F.col("all_found")).alias("s"), secrets.redacted(F.col("text"), F.col("all_found")).alias("t")).collect():
        assert (r["s"], r["t"]) == brute_scan(r["text"]), r["doc_id"]


def test_secrets_of_an_empty_table(spark):
    assert secrets.scanned(nasty.empty(spark)).count() == 0


def test_redaction_takes_spans_out(spark):
    df = secrets.scanned(nasty.documents(spark)).select("doc_id", secrets.redacted(F.col("text"), F.col("all_found")).alias("t"))
    got = {r["doc_id"]: r["t"] for r in df.where("doc_id in (0, 4, 8)").collect()}
    assert got[0] is None and got[4] == "word" and "1beb58" not in got[8] and "AKIA" not in got[8] and "PASSWORD:abc" in got[8]


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pii_keeps_format_and_links(spark):
    out = pii.pseudonymised(nasty.documents(spark), "k").collect()
    assert len(out) == len(nasty.rows())
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] != 17}
    r = by[9]
    assert [r[f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1, 2, 1, 0]
    for gone in ("bosbt", "4041894974608795", "4111 1111", "42.144.35.254", "988) 555-2485", "1987-02-28", "123-45-6789"):
        assert gone not in r["text"]
    for stays in ("999.1.1.1", "1987-02-30", "000-45-6789", " 12 34"):
        assert stays in r["text"]
    card = re.search(r"card (\d{16}) or (\d{4} \d{4} \d{4} \d{4}) at", r["text"])
    assert luhn(card[1]) and luhn(card[2].replace(" ", ""))
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} born (19|20)\d\d-\d\d-\d\d not", r["text"])
    assert by[0]["text"] is None and by[1]["text"] == "" and by[12]["text"] == nasty.TEXTS[12]
    beside = pii.pseudonymised(spark.createDataFrame([(1, "4041894974608795 53 apples, 10 20 30 40 50, x4041894974608795, 212.555.0187")], "doc_id long, text string"), "k").first()
    assert (beside["n_card"], beside["n_phone"]) == (1, 1) and " 53 apples, 10 20 30 40 50, x4041894974608795, " in beside["text"] and "0187" not in beside["text"]
    again = spark.createDataFrame([(1, "so 4041894974608795 again"), (2, "4041-8949-7460-8795")], "doc_id long, text string")
    first, second = (r["text"] for r in pii.pseudonymised(again, "k").orderBy("doc_id").collect())
    assert card[1] in first and second.replace("-", "") == card[1]
    assert pii.pseudonymised(again, "other").orderBy("doc_id").first()["text"] != first
    assert pii.pseudonymised(nasty.empty(spark), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(0, 17 * 43).select(pii.feistel(F.floor(F.col("id") / 43), F.col("id") % 43, F.lit(17), F.lit(43), F.lit("k"), "t").alias("x"))
    assert df.distinct().count() == 17 * 43 and df.where("x.l < 0 or x.l >= 17 or x.r < 0 or x.r >= 43").count() == 0


class Pseudonyms:
    """The same pseudonyms in plain Python."""

    def __init__(self, key):
        self.key = key

    def feistel(self, x, y, a, b, tweak):
        for i in range(8):
            h = lambda v: int(hashlib.sha256(f"{self.key}|{tweak}|{a}|{b}|{i}|{v}".encode()).hexdigest()[:15], 16)
            if i % 2 == 0:
                x = (x + h(y)) % a
            else:
                y = (y + h(x)) % b
        return x, y

    def digits(self, d, tweak):
        n = len(d) // 2
        x, y = self.feistel(int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n), tweak)
        return f"{x:0{n}d}{y:0{len(d) - n}d}"

    def into(self, shape, digits):
        left = iter(digits)
        return "".join(next(left) if c in "0123456789" else c for c in shape)

    def of(self, m):
        d = "".join(c for c in m if c in "0123456789")
        full = lambda p: regex.fullmatch(p, m)
        if "@" in m:
            return "email", "u" + hashlib.sha256(f"{self.key}|email|{m.lower()}".encode()).hexdigest()[:24] + "@mail.invalid"
        if m[0].isalpha():
            plain = m.replace(" ", "")
            value = lambda t: int("".join(str(int(c, 36)) for c in t))
            if not 15 <= len(plain) <= 34 or value(plain[4:] + plain[:4]) % 97 != 1:
                return None, m
            rest = self.into(plain[4:], self.digits("".join(c for c in plain[4:] if c.isdigit()), "iban"))
            out = plain[:2] + f"{98 - value(rest + plain[:2] + '00') % 97:02d}" + rest
            return "iban", " ".join(textwrap.wrap(out, 4)) if " " in m else out
        if full(pii.DATE):
            form = "%Y-%m-%d" if "-" in m else "%d.%m.%Y" if "." in m else "%d/%m/%Y"
            try:
                day = (datetime.strptime(m, form) - datetime(1900, 1, 1)).days
            except ValueError:
                return None, m
            x, y = self.feistel(day // 4297, day % 4297, 17, 4297, "date")
            return "date", (datetime(1900, 1, 1) + timedelta(x * 4297 + y)).strftime(form)
        if full(pii.ADDRESS):
            o = [int(x) for x in m.split(".")]
            if max(o) > 255:
                return None, m
            x, y = self.feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "address")
            return "address", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
        if full(pii.SSN):
            area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
            areas = [a for a in range(1, 900) if a != 666]
            if area not in areas or not group or not serial:
                return None, m
            x, y = self.feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
            return "ssn", f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
        if full(pii.CARD) and 13 <= len(d) <= 19 and luhn(d):
            body = self.digits(d[:-1], "card")
            return "card", self.into(m, body + next(c for c in "0123456789" if luhn(body + c)))
        if full(pii.PHONE) and 9 <= len(d) <= 15:
            keep = max(len(d) - 10, 0)
            return "phone", self.into(m, d[:keep] + self.digits(d[keep:], "phone"))
        return None, m

    def text(self, text):
        n, out, at = Counter(), "", 0
        for m in regex.finditer(pii.ANY, text):
            kind, new = self.of(m[0])
            n[kind] += 1
            out += text[at : m.start()] + new
            at = m.end()
        return (out + text[at:], *(n[k] for k in pii.KINDS))


def test_pii_matches_brute_force(spark):
    import random

    draw = random.Random(3)
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def bit():
        card, account = number(15), number(18)
        check = next(c for c in "0123456789" if luhn(card + c))
        iban = f"DE{98 - int(account + '131400') % 97:02d}{account}"
        return draw.choice((
            f"me.{number(2)}@Host{number(1)}.example.org", f"a@b.com_{number(1)}@y.de", card + check, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}{check}", card + "0", f"{number(3)}-{number(2)}-{number(4)}",
            f"{draw.randint(1900, 2099)}-0{draw.randint(1, 9)}-{draw.randint(10, 31)}", f"{draw.randint(10, 31)}{draw.choice('./')}0{draw.randint(1, 9)}.{draw.randint(1900, 2099)}", f"{number(3)}.{number(2)}.{number(1)}.{number(3)}",
            f"+{number(2)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)} {number(4)}", iban, " ".join(textwrap.wrap(iban, 4)), iban[:-1] + "x", number(5), "word", "Été", "@", "🙂", "x@y", "1987-02-30",
        ))

    texts = ["", "plain words", " ".join(f"{100 + i % 500}-12-{1000 + i % 9000}" for i in range(5000)), "1." * 20000, "x" * 100000, "a@" * 20000, "666-12-3456 665-01-0001 667-99-9999 900-11-1111"]
    texts += [draw.choice((" ", ", ", "\n")).join(bit() for _ in range(k)) for k in [1] * 40 + [2, 3, 5, 8, 40, 400, 2000]]
    got = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key")
    for r in got.collect():
        assert tuple(r)[1:] == Pseudonyms("key").text(texts[r["doc_id"]]), r["doc_id"]
    ssn = re.findall(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", next(r for r in got.collect() if r["doc_id"] == 2)["text"])
    assert len(set(ssn)) > 4000 and all(x[:3] not in ("000", "666") and x < "9" and x[4:6] != "00" and x[7:] != "0000" for x in ssn)


def test_pii_key_is_asked_for_and_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "4041894974608795")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.pseudonymised(docs, "")
    out = pii.pseudonymised(docs, "very-secret-key")
    out.collect()
    assert "very-secret-key" not in out._jdf.queryExecution().toString()
    assert len(pii.session_key(spark)) == 64 and pii.session_key(spark) == pii.session_key(spark)


def test_licences(spark):
    whole = licences.KNOWN[-1][2].replace("Permission is", "Copyright (c) 2021 Me\n\nPERMISSION, is").replace("software", "SOFTWARE")
    rows = [*nasty.rows(), (50, whole, "en", None, None, None, None, None, None, None), (51, whole + " more", "en", None, None, None, None, None, None, None)]
    got = licences.scanned(spark.createDataFrame(rows, nasty.SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[6]["license"], by[6]["notices"], by[6]["policy"]) == ("MIT", "MIT", "allow")
    assert (by[7]["license"], by[7]["notices"], by[7]["policy"]) == (None, "MIT,proprietary", "forbid")
    assert by[50]["license"] == "MIT" and by[51]["license"] is None and by[0]["policy"] == "none"
    assert licences.scanned(nasty.empty(spark)).count() == 0


def glob_regex(glob):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.DOTALL)


def test_glob_automaton_matches_regular_expressions():
    globs = ["*", "", "a*", "*a", "a?c", "*b*c", "abc", "*" + "long" * 40 + "*", "??", "*é*", "a**b", "x*y*z"]
    texts = ["", "a", "ab", "abc", "aXc", "xxbyyc", "long" * 41, "é", "aéb", "xyz", "x1y2z", "x1y2z3", "ba", "a" * 300 + "b", "🙂é"]
    got = urls.GlobAutomaton(globs).match(texts)
    assert got.tolist() == [[bool(glob_regex(g).fullmatch(t)) for g in globs] for t in texts]


def test_urls(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://EXAMPLE.net/de/?q#f": ("example.net", "/de/", "net/", "block"),
        "https://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"),
        "https://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "https://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
        "http://net": ("net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "https://casino-win.example.com/en/1": ("casino-win.example.com", "/en/1", None, "block"),
        "HTTPS://Adult-X.example.org:443/%65n": ("adult-x.example.org:443", "/%65n", None, "block"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(cases)] * 2, "page_id long, url string, html string, host string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages).collect())
    assert got == Counter({(i, *want): 2 for i, want in enumerate(cases.values())})
    assert urls.judged(pages.limit(0)).count() == 0


def test_language_held_out_accuracy_and_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fitted_on(docs)
    held = docs.where(language.fold(F.col("doc_id")) == 2)
    right = language.identified(held.drop("source"), model).where(F.col("lang") == F.col("lang_pred")).count()
    assert right / held.count() > 0.98
    got = language.identified(nasty.documents(spark), model)
    assert got.count() == len(nasty.rows())
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by[0] == by[1] == by[2] == by[3] == ("und", 0.0) and all(0 <= s <= 1 for _, s in by.values())
    assert language.identified(nasty.empty(spark), language.fitted_on(nasty.empty(spark))).count() == 0


def test_full_licence_texts_are_found_with_title_and_holder(spark):
    mit = next(t for n, _, t in licences.KNOWN if n == "MIT" and len(t) > 500)
    bsd = (Path(licences.__file__).parent / "license_texts" / "BSD-3-Clause.txt").read_text()
    holder = "Copyright (c) 2020 X. All rights reserved."
    texts = ["MIT License\n\nCopyright (c) 2020 X\n\n" + mit, f"The MIT License (MIT)\n{holder}\n{mit}", bsd.replace("Copyright (c) <year>, <holder>", holder)]
    texts += [(Path(licences.__file__).parent / "license_texts" / f"{n}.txt").read_text() for n in ("Apache-2.0", "GPL-3", "MPL-2.0")] + ["A readme.\n" + textwrap.fill(mit, 60) + "\nMore.", mit[:-200]]
    rows = licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = [(r["license"], r["notices"], r["policy"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
    whole = [(n, "", p) for n, p in (("MIT", "allow"), ("MIT", "allow"), ("BSD-3-Clause", "allow"), ("Apache-2.0", "allow"), ("GPL-3.0", "review"), ("MPL-2.0", "review"))]
    assert [(a, c) for a, _, c in got[:6]] == [(a, c) for a, _, c in whole]
    assert got[6:] == [(None, "MIT", "allow"), (None, "", "none")]


@pytest.fixture(scope="module")
def licence_rows(spark):
    """What is found in each licence file as it is, among prose with other line breaks, and cut short."""
    texts, folder = {}, Path(licences.__file__).parent / "license_texts"
    files = {n: (name, policy, (folder / f"{n}.txt").read_text()) for n, (name, policy) in licences.FULL.items()}
    files |= {n: (n, p, t) for n, p, t in licences.KNOWN if len(t) > 500}
    for n, (_, _, text) in files.items():
        texts[n, "whole"] = text
        texts[n, "holder"] = "Copyright (c) 1999-2024 Some Body <x@y.org>. All rights reserved.\n\n" + text.upper()
        texts[n, "among"] = "A readme of a thing.\n\n" + "\n".join(x if re.search(licences.HOLDER, x) else textwrap.fill(x, 50) for x in text.split("\n")) + "\n\nint main() { return 0; }"
        texts[n, "cut"] = text[: len(text) // 2]
    keys = list(texts)
    rows = licences.scanned(spark.createDataFrame([(i, texts[k]) for i, k in enumerate(keys)], "doc_id long, text string")).collect()
    return files, {keys[r["doc_id"]]: r for r in rows}


@pytest.mark.parametrize("file", [*licences.FULL, "MIT", "ISC"])
def test_every_licence_file_is_found(licence_rows, file):
    files, rows = licence_rows
    name, policy, _ = files[file]
    at_least = lambda r: licences.POLICIES.index(r["policy"]) >= licences.POLICIES.index(policy)
    assert rows[file, "whole"]["license"] == name and at_least(rows[file, "whole"])
    assert rows[file, "holder"]["license"] == name
    assert rows[file, "among"]["license"] is None and name in rows[file, "among"]["notices"].split(",") and at_least(rows[file, "among"])
    assert rows[file, "cut"]["license"] is None and name not in rows[file, "cut"]["notices"].split(",")


def test_spellings_are_of_whole_words_and_the_strictest_policy_holds(spark):
    texts = (("A", "allow", "the programmer has a license"), ("B", "forbid", "The Programmer -- has a LICENCE"), ("C", "allow", "organisation organisation"))
    docs = spark.createDataFrame([(1, "The programmer has a licence!"), (2, "the programr has a license"), (3, "organization  organisation")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["policy"]) for r in licences.scanned(docs, texts, []).collect()}
    assert got == {1: ("A", "forbid"), 2: (None, "none"), 3: ("C", "allow")}


def test_redacted_beside_clashing_aliases(spark):
    """An earlier alias of the same select with the text's or the spans' name changes nothing."""
    text = "keep token = abcdef123 and password: zzzzzzz end"
    found = secrets.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    new = secrets.redacted(F.col("text"), F.col("all_found"))
    want = found.select(new.alias("other")).first()[0]
    assert want.count("[SECRET]") == 2 and want.startswith("keep ") and want.endswith(" end")
    for df in (found, found.cache()):
        row = df.select("doc_id", F.lit("zz").alias("text"), F.lit(0).alias("all_found"), new.alias("new"), F.length(new).alias("n")).first()
        assert (row["new"], row["n"]) == (want, len(want))
        row = df.select("doc_id", new.alias("text"), F.length(new).alias("n")).first()
        assert (row["text"], row["n"]) == (want, len(want))


APACHE_HEADER = """/*
 * Copyright 2020 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the
 * License. You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
package a;"""
GPL_HEADER = """# This file is part of Thing.  Thing is free software: you can redistribute it and/or
# modify it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
import a"""


def test_headers_of_files_are_found_among_code(spark):
    cases = {
        APACHE_HEADER: ("Apache-2.0", "allow"),
        GPL_HEADER.format("", "3"): ("GPL-3.0", "review"),
        GPL_HEADER.format("", "2"): ("GPL-2.0", "review"),
        GPL_HEADER.format("Lesser ", "2.1"): ("LGPL-2.1", "review"),
        GPL_HEADER.format("Affero ", "3"): ("AGPL-3.0", "review"),
        GPL_HEADER.format("", "9"): ("", "none"),
        "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy": ("MPL-2.0", "review"),
        "x Use of this source code is governed by a BSD-style\nlicence that can be found in the LICENSE file.": ("BSD-style", "allow"),
        "terms of the GNU " * 20_000: ("", "none"),
        "Licensed under the Apache License, Version 2.0 (the ": ("", "none"),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: (r["notices"], r["policy"]) for r in licences.scanned(docs).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    with pytest.raises(ValueError, match="words"):
        licences.scanned(docs, (), [("A", "allow", "too short")])


def test_known_texts_among_words_are_those_that_contain_finds(spark):
    """Against plain Python, over few words, so that texts begin and end within each other and again and again."""
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    full = [(f"L{i}", "allow", t) for i, t in enumerate(dict.fromkeys(some(rng.randint(5, 12)) for _ in range(25)))]
    texts = [some(rng.randint(0, 60)) for _ in range(200)]
    rows = licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (), full).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["notices"] == ",".join(sorted(n for n, _, t in full if f" {t} " in f" {text} "))  # a text of one line gives that line too
        assert r["license"] == next((n for n, _, t in full if t == text), None)


def spdx_plainly(parts, ranks):
    """Ids and rank by recursive descent."""
    ids, at = [], 0

    def operand():
        nonlocal at
        if at < len(parts) and parts[at] == "(":
            at += 1
            value = either()
            at += 1
        else:
            ids.append(re.sub(r"(\+|-only|-or-later)$", "", parts[at].lower()))
            at += 1
            value = ranks.get(ids[-1], 2)
            if at < len(parts) and parts[at] == "WITH":
                at += 2
        return value

    def both():
        nonlocal at
        value = operand()
        while at < len(parts) and parts[at] == "AND":
            at += 1
            value = max(value, operand())
        return value

    def either():
        nonlocal at
        value = both()
        while at < len(parts) and parts[at] == "OR":
            at += 1
            value = min(value, both())
        return value

    return either(), ids


def test_spdx_expressions_against_recursive_descent(spark):
    rng, ranks = random.Random(11), {"mit": 1, "isc": 1, "gpl-3.0": 2, "cc-by-nc-4.0": 3}

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(["MIT", "ISC", "GPL-3.0-or-later", "GPL-3.0+", "CC-BY-NC-4.0", "Other-1.0"]), *(["WITH", "Some-exception"] if rng.random() < 0.2 else [])]
        left, right = expression(depth - 1), expression(depth - 1)
        out = [*left, rng.choice(["AND", "OR"]), *right]
        return ["(", *out, ")"] if rng.random() < 0.5 else out

    cases = [expression(rng.randint(0, 4)) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(c).replace("( ", "(")) for i, c in enumerate(cases)], "i long, e string")
    got = {r["i"]: (r["v"]["rank"], r["v"]["ids"]) for r in docs.select("i", licences.spdx(F.col("e"), ranks).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [spdx_plainly(c, ranks) for c in cases]
    lines = {
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;": ("Apache-2.0,MIT", "allow"),
        "<!-- SPDX-License-Identifier: MIT AND CC-BY-NC-4.0-->": ("CC-BY-NC-4.0,MIT", "forbid"),
        "spdx-license-identifier: unknown": ("", "none"),
        "SPDX-License-Identifier: MIT AND (": ("MIT", "allow"),
        "SPDX-License-Identifier: ) MIT x": ("", "none"),
        "SPDX-License-Identifier:\nMIT\nx": ("", "none"),
        "SPDX-License-Identifier: ISC and more\nSPDX-License-Identifier: GPL-3.0": ("GPL-3.0,ISC", "review"),
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: (r["notices"], r["policy"]) for r in licences.scanned(docs).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())


def test_licence_sql_knows_full_texts_and_headers(spark):
    """DuckDB and Spark over every licence file whole, among code and cut, over headers, and over rows that are hard."""
    texts = [t for _, _, t in licences.full_texts()] + [APACHE_HEADER, GPL_HEADER.format("", "3"), *nasty.TEXTS]
    texts += [f"A readme\n{t}\nCopyright (c) 2020 X\nint main() {{}}" for t in texts if t] + [t[: len(t) // 2] for t in texts if t]
    rows = [(i, t) for i, t in enumerate(texts)]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        want = con.execute(licences.duckdb_sql()).fetchall()
    got = licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license", "notices", "policy").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
