import random
import re
from collections import defaultdict

from assaylake.llm import substring_dedup as sd


def brute(rows, span=sd.SPAN, least=sd.MIN_WORDS):
    """Removed sentence places by (doc_id, text), by the definition."""
    texts = sorted({(r.doc_id, r.text) for r in rows if r.text is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    places = defaultdict(list)
    for n, (_, text) in enumerate(texts):
        words = [w for _, _, w in sd.sentences(text)]
        for i in range(len(words) - span + 1):
            run = tuple(map(tuple, words[i : i + span]))
            if sum(map(len, run)) >= least:
                places[run].append((n, i))
    gone = defaultdict(set)
    for found in places.values():
        for n, i in sorted(found)[1:]:
            gone[n] |= set(range(i, i + span))
    return {key: gone[n] for n, key in enumerate(texts)}


def test_sentences_tile_the_text():
    for text in ("", " a. b! c\n\nd", "One. Two?  Three", "\n\nx. \n", "no end", "a.b c. d"):
        parts = sd.sentences(text)
        assert not parts or "".join(text[a:b] for a, b, _ in parts) == text


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sd.dedup(docs).collect()
    want = brute(docs.collect())
    source = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(source) and any(r.n_removed for r in rows)
    for r in rows:
        text, gone = source[r.doc_id], want[r.doc_id, source[r.doc_id]]
        parts = sd.sentences(text)
        assert r.n_removed == len(gone) and r.n_sentences == len(parts)
        assert r.text == "".join(text[a:b] for i, (a, b, _) in enumerate(parts) if i not in gone)


def test_planted_passage(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi rho. Sigma tau upsilon phi chi psi omega end here."
    docs = spark.createDataFrame([(1, f"First start. {passage} First end."), (2, f"Second start. {passage} Second end."), (3, "Clean text stays. Nothing to see here.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sd.dedup(docs).collect()}
    assert got == {1: f"First start. {passage} First end.", 2: "Second start. Second end.", 3: "Clean text stays. Nothing to see here."}


def test_odd_rows(odd_docs, no_docs):
    rows = sd.dedup(odd_docs.withColumnRenamed("label", "removed")).collect()
    assert len(rows) == 12
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[2][0].text is None and by[2][0].n_sentences == 0
    assert by[1][0].text == "" and by[7][0].text == "  \n\t \n"
    assert by[5][0].text == "" and by[4][0].text == by[4][1].text != ""
    assert sd.dedup(no_docs).count() == 0
    assert sd.dedup_documents(odd_docs).columns == odd_docs.columns


def brute_every_length(rows, span=sd.SPAN, least=sd.MIN_WORDS):
    """Removed (start, end) units by document, by the definition."""
    places, gone = defaultdict(list), defaultdict(set)
    for r in sorted(rows, key=lambda r: r.doc_id):
        own, owners = sd.pieces(r.text)
        found = set()
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                enough = sum(len(w) for _, _, w in own[i:j]) >= least
                starts, ends = not i or owners[i - 1] != owners[i], j == len(own) or owners[j] != owners[j - 1]
                if enough and starts and ends and owners[j - 1] - owners[i] == span - 1:
                    found.add((i, j))
                without_first = sum(len(w) for _, _, w in own[i + 1 : j])
                if enough and (without_first < least or sum(len(w) for _, _, w in own[i : j - 1]) < least):
                    found.add((i, j))
                if owners[j - 1] - owners[i] >= span and without_first >= least:
                    break
        for i, j in found:
            places[tuple(tuple(w) for _, _, w in own[i:j])].append((r.doc_id, i, j))
    for found in places.values():
        for doc_id, i, j in sorted(found)[1:]:
            gone[doc_id] |= set(range(i, j))
    return gone


def test_every_length_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    given = {r.doc_id: r for r in docs.collect()}
    want = brute_every_length(given.values())
    rows = sd.dedup(docs, every_length=True).collect()
    assert len(rows) == len(given)
    for r in rows:
        own, owners = sd.pieces(given[r.doc_id].text)
        assert r.text == "".join(given[r.doc_id].text[a:b] for i, (a, b, _) in enumerate(own) if i not in want[r.doc_id])
        assert r.n_sentences == len(sd.sentences(given[r.doc_id].text)) and r.n_removed == len({owners[i] for i in want[r.doc_id]})


def test_pieces_tile_the_text():
    for text in ("", "  a b. " + "w " * 100 + "x.  End", "\n" + " ".join(f"w{i % 7}" for i in range(90)) + "\n\n"):
        parts, owners = sd.pieces(text)
        assert not parts or "".join(text[a:b] for a, b, _ in parts) == text
        assert all(text[a:b].lower().split() == w and len(w) <= sd.LONG for a, b, w in parts)
        assert len(set(owners)) == len(sd.sentences(text))


def test_passages_that_two_sentences_miss(spark):
    """One-sentence copies, a 60-word sentence between different ones or inside a longer one, short lines."""
    single = " ".join(f"s{i}" for i in range(14)) + "."
    long = " ".join(f"m{i}" for i in range(60))
    lines = "\n".join(f"l{i} k{i} j{i}" for i in range(20))
    texts = [single, single, f"Before one. {long}. After one.", f"Another start. {long}. Another end.", f"Starts as {long} ends so.", f"Head a.\n{lines}\nTail a.", f"Head b.\n{lines}\nTail b."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sd.dedup(docs, every_length=True).collect()}
    assert [got[i].text for i in (0, 2, 5)] == [texts[0], texts[2], texts[5]]
    assert got[1].text == "" and got[3].text == "Another start. Another end." and got[6].text == "Head b.\nTail b."
    left = got[4].text.split()
    assert left[:2] == ["Starts", "as"] and left[-2:] == ["ends", "so."] and len(left) < 4 + 2 * sd.LONG and got[4].n_removed == 1
    assert {r.doc_id for r in sd.dedup_documents(docs).collect()} == {0, 2, 3, 4, 5, 6}


def test_sentences_follow_the_definition():
    """A sentence ends after a newline, or after an end mark before white space."""
    rng, signs = random.Random(3), ["a", "Bé", "ÄÖ", ".", "!", "?", " ", "\n", "\t", "\u2003", "İ", "x1", "日本", "\x1c", "\x85"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(50)))
        want, at = [], 0
        for m in re.finditer(r"[.!?]\s+|\n\s*", text):
            if text[at : m.end()].split():
                want.append((at, m.end()))
                at = m.end()
        if text[at:].split():
            want.append((at, len(text)))
        elif want:
            want[-1] = (want[-1][0], len(text))
        assert [(a, b) for a, b, _ in sd.sentences(text)] == want


def test_equal_runs_have_equal_hashes():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    seen = {}
    for _ in range(300):
        text = " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randrange(1, 60)))
        own, _ = sd.pieces(text)
        _, at, size, h, check = sd.run_hashes([text], 2, 3, True)
        for i, n, key in zip(at.tolist(), size.tolist(), zip(h.tolist(), check.tolist(), strict=True), strict=True):
            run = tuple(tuple(w) for _, _, w in own[i : i + n])
            assert seen.setdefault(key, run) == run
    assert len(set(seen.values())) == len(seen)


def test_texts_cut_together_are_cut_alike():
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab ", "c. ", "d\n", " ", "e", "."]) for _ in range(rng.randrange(80))) for _ in range(50)] + [None, "", " \n"]
    rng.shuffle(texts)
    number, *together = sd.run_hashes(texts, 2, 3, True)
    for i, text in enumerate(texts):
        _, *alone = sd.run_hashes([text], 2, 3, True)
        assert [x[number == i].tolist() for x in together] == [x.tolist() for x in alone]
