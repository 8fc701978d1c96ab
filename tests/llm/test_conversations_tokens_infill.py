"""Conversation repair, token counts and fill-in-the-middle against brute force, the tokenizer library and an exact round trip."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import conversations, infill, tokencounts

UNIT = re.compile(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, _n int, _output string, _counts int, _text string"


def texts():
    rng = random.Random(8)
    words = ["the", "can't", "we're", "they've", "I'll", "naïve", "日本語", "12", "3.5", "--", "...", "<|endoftext|>", "<|endof", "é" * 5, "$1", "\\", "<S", "\x1c", "\x85"]
    out = [None, "", " ", "\n \t", "one", " one", "one ", "a <P> b", "x<S", "<M>", "  two  spaces ", "A" * 30000, "'re", "'r", "don''t've"]
    for _ in range(150):
        out.append("".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n", " \n "]) for _ in range(rng.randint(1, 40))))
    out.append(" ".join(rng.choice(words) for _ in range(60000)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", 1, 2, "o", 3, "t") for i, t in enumerate(texts())]
    rows += [rows[20], (None, "no id <here>", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string, audit string, _by int, _found string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("query", [infill.op11, tokencounts.op12, conversations.op13])
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).count() == 0


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_infill(spark, folder):
    want = []
    for doc_id, text in [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]:
        units = UNIT.findall(text)
        assert "".join(units) == text
        n = len(units)
        digest = sha(f"42:{'' if doc_id is None else doc_id}")
        h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        parts = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            want.append((doc_id, n, "plain", None, None, sha(text), sha(text)))
        else:
            form = "spm" if h[3] % 100 < 80 else "psm"
            out = f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}" if form == "spm" else f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"
            want.append((doc_id, n, form, len(parts[0]), len(parts[1]), sha(out), sha(text)))
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert sorted_rows(infill.op11(spark, folder)) == sorted(want, key=repr)


def test_infill_of_all_texts_with_other_markers(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    marks = ("[[p]]", "[[s]]", "[[m]]")
    quoted = tuple(re.escape(m) for m in marks)
    rows = infill.infill(docs, seed=7, rate=100, spm_rate=50, markers=marks)
    assert rows.columns[:3] == docs.columns
    back = rows.select("_form", (infill.restored(F.col("_output"), F.col("_form"), quoted) == F.col("_text")).alias("same")).collect()
    assert all(r.same for r in back)
    assert {r._form for r in back} == {"plain", "spm", "psm"}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return tokencounts.PrefixTable(file.read())


def test_every_prefix_has_the_library_s_count(library, counter):
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    for text in [t for t in texts() if t is not None and len(t) < 300]:
        found = counter.counts(text)
        assert [int(c) for c in found] == [count(text[:i]) for i in range(len(text) + 1)], text


def test_characters_are_cut_as_the_library_cuts_them(library, counter):
    rng = random.Random(1)
    for code in rng.sample([c for c in range(0x30000) if not 0xD800 <= c < 0xE000], 4000):
        text = f"a{chr(code)}b 1{chr(code)}{chr(code)} {chr(code)}"
        assert counter.counts(text)[-1] == len(library.encode(text, add_special_tokens=False).ids), hex(code)


def test_token_counts(spark, folder, library):
    want = []
    for doc_id, text in [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]:
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((doc_id, len(text.encode()), n, n > 512))
    got = tokencounts.op12(spark, folder)
    assert sorted_rows(got.drop("fit_chars")) == sorted(want, key=repr)
    assert any(w[3] for w in want)
    # The longest prefix within the limit ends where the library says so.
    long = spark.read.parquet(f"{folder}/documents.parquet").filter("length(text) > 100000").first().text
    fit = got.orderBy(F.desc("n_tokens")).first().fit_chars
    count = lambda k: len(library.encode(long[:k], add_special_tokens=False).ids)
    assert count(fit) <= 512 and all(count(k) > 512 for k in range(fit + 1, fit + 40))


def test_questions_to_the_prefix_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").filter("length(text) < 300")
    rows = tokencounts.prefix_counts(docs).select(
        "text", "_counts", tokencounts.longest_within(F.col("_counts"), 5).alias("fit"), tokencounts.tokens_of(F.col("_counts"), 3).alias("three")).collect()
    for r in rows:
        assert len(r._counts) == len(r.text) + 1 and r._counts[0] == 0
        assert r.fit == max(i for i, c in enumerate(r._counts) if c <= 5)
        assert r.three == (r._counts[3] if len(r.text) >= 3 else None)


def test_pieces_forgotten_are_found_again(counter, monkeypatch):
    sample = [t for t in texts() if t is not None and len(t) < 2000]
    want = [counter.counts(t).tolist() for t in sample]
    monkeypatch.setattr(tokencounts, "KEEP_PIECES", 3)
    monkeypatch.setattr(tokencounts, "KEEP_PAIRS", 2)
    monkeypatch.setattr(tokencounts, "KEEP_PIECE", 4)
    counter.known, counter.earlier, counter.fits = {}, {}, {}
    assert [counter.counts(t).tolist() for t in sample] == want


def turns():
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        turn, role = 0, "user"
        for i in range(rng.randint(0, 14)):
            role = rng.choice(["user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.25 else ("assistant" if role == "user" else "user")
            text = rng.choice(["Done.", "And so on", "Why?", "  ", "", None, "Yes!\n ", "é.", "Ends here.\x0b"]) if rng.random() < 0.5 else f"Turn {rng.random()}."
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text, "x", 1, "y"))
            turn += rng.choice([1, 1, 1, 1, 2, 0])
    rows += [rows[30], rows[30], (None, 1, "user", "No id.", "x", 1, "y"), (None, None, None, None, None, None, None), (None, 2, "assistant", "Answer.", "x", 1, "y")]
    rows += [(2000 + i, 0, "user", "Alone.", "x", 1, "y") for i in range(60)]  # some lose their only row
    # A conversation of very many rows.
    rows += [(1000, i, "user" if i % 2 else "assistant", f"Row {i}{'.' if i % 5 else ''}", "x", 1, "y") for i in range(3000)]
    return rows


def cheapest(rows):
    """Forward over rows and states, keeping the least (cost, letters, repaired rows) of each state."""
    turn = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}

    def inserts(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, r) in list(out.items()):
                out[turn[s]] = min(out.get(turn[s], (1 << 40,)), (c + 5, a + "I", [*r, f"{name[turn[s]]}:"]))
        return out

    states = {0: (0, "", [])}
    for role, text, forced, cut in rows:
        new = {}
        for s, (c, a, r) in inserts(states).items():
            options = [(s, (c + 2, a + "D", r))]
            if not forced:
                options.append((turn[s], (c + 1 + 5 * cut, a + "R", [*r, f"{name[turn[s]]}:{text}"])))
                if role[:1] == "s" and s == 0:
                    options.append((1, (c + 5 * cut, a + "K", [*r, f"{role}:{text}"])))
                if role[:1] == name[turn[s]][0]:
                    options.append((turn[s], (c + 5 * cut, a + "K", [*r, f"{role}:{text}"])))
            for t, v in options:
                if t not in new or v[:2] < new[t][:2]:
                    new[t] = v
        states = new
    return min(v for s, v in inserts(states).items() if s in (0, 3))


def test_conversation_repair(spark, folder):
    groups = {}
    for r in turns():
        groups.setdefault(r[0], []).append(r)
    want = []
    for conv, rows in groups.items():
        rows = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        after = []
        for turn, role, text in rows:
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 1:
                text = ""
            elif h == 2:
                text = re.sub("[.!?]", "", text)
            elif h == 4:
                role = "user"
            after += [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)
        known = [t for t, _, _ in after if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        items, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in after:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            items.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum((a[1][:1] or "?") + (b[1][:1] or "?") not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, out = cheapest(items)
        want.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(out))))
    assert sum(w[2] for w in want) and sum(w[3] for w in want) and any(w[7] == "" for w in want)
    assert sorted_rows(conversations.op13(spark, folder)) == sorted(want, key=repr)


def test_search_against_all_edits():
    rng = random.Random(2)

    def every(rows):
        best = (2 * len(rows), "D" * len(rows))

        def go(i, inserted, cost, audit, roles):
            nonlocal best
            if cost > best[0]:
                return
            if i == len(rows) and regex.fullmatch("(s?(ua)+)?", roles):
                best = min(best, (cost, audit))
            if inserted < 2:
                for r in "ua":
                    go(i, inserted + 1, cost + 5, audit + "I", roles + r)
            if i < len(rows):
                letter, forced, cut = rows[i]
                go(i + 1, inserted, cost + 2, audit + "D", roles)
                if not forced:
                    go(i + 1, inserted, cost + 5 * cut, audit + "K", roles + letter)
                    for r in "ua":
                        go(i + 1, inserted, cost + 1 + 5 * cut, audit + "R", roles + r)
        go(0, 0, 0, "", "")
        return best

    for _ in range(400):
        rows = [(rng.choice("sua?ua"), rng.random() < 0.1, False) for _ in range(rng.randint(0, 5))]
        rows = [(letter, forced, not forced and rng.random() < 0.2) for letter, forced, _ in rows]
        assert conversations.search(rows) == every(rows)


def test_search_with_dear_deletions(monkeypatch):
    """With deletions at 9 insertions win, and with no bounds at all the table of dominated prefixes still gives the optimum."""
    monkeypatch.setattr(conversations, "DELETE", 9)
    monkeypatch.setattr(conversations, "REROLE", 7)
    assert conversations.search([("u", False, False)]) == (5, "KI")
    assert conversations.search([("s", False, False), ("a", False, False)]) == (5, "KIK")
    rng = random.Random(4)
    cases = [[(rng.choice("sua?"), rng.random() < 0.1, False) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    tight = [conversations.search(rows) for rows in cases]
    monkeypatch.setattr(conversations, "suffix_bounds", lambda rows: [[0] * 4 for _ in range(len(rows) + 1)])
    assert [conversations.search(rows) for rows in cases] == tight


def test_repaired_rows(spark, folder):
    rows = conversations.ordered(spark.read.parquet(f"{folder}/conversations.parquet"))
    found = conversations.audits(rows)
    texts = {}
    for r in conversations.repaired_texts(rows, found).collect():
        texts.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    hashes = {r.conv_id: r.repaired_sha256 for r in conversations.repaired(rows).collect()}
    for conv, digest in hashes.items():
        out = sorted(texts.get(conv, []))
        assert sha("\n".join(f"{role}:{text}" for _, role, text in out)) == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in out))
