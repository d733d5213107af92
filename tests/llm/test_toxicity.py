import zlib

import numpy as np

from sangloc.llm import toxicity
from sangloc.llm.queries import op2_toxicity_grammar


def kinds(text):
    return [{k for k, x in zip(toxicity.KINDS, sums) if x} for _, _, sums in toxicity.seeds().clauses(text)]


def test_kinds_of_matches():
    assert kinds("What an idiot. Fine.") == [{"plain"}]
    assert kinds("you are an idiot") == [{"targeted"}]
    assert kinds("this is not an idiot") == [{"negated"}]
    assert kinds("not here, at the far end, an idiot") == [{"plain"}]
    assert kinds("she said idiot") == [{"reported"}]
    assert kinds('the word "idiot" is old; idiot!') == [{"reported"}, {"plain"}]
    assert kinds("I will kill you") == [{"threat"}]
    assert kinds("they will kill") == [{"threat"}]
    assert kinds("never kill you") == []
    assert kinds("kill time") == [] and kinds("you") == [] and kinds("") == [] and kinds(None) == []


def test_spans_of_clauses():
    text = "Good day. IDIOT here\nyes"
    (start, end, _), = toxicity.seeds().clauses(text)
    assert text[start:end] == " IDIOT here"


def test_composition_equals_feeding_one_after_the_other():
    rng = np.random.default_rng(3)
    machines = [toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.THREAT]
    for _ in range(200):
        symbols = rng.integers(0, len(toxicity.SYMBOLS), 12)
        states, state = [m.start for m in machines], 0
        for s in symbols:
            symbol = toxicity.SYMBOLS[s]
            for i, m in enumerate(machines):
                states[i], symbol = m.step(states[i], symbol)
            state, said = toxicity.GRAMMAR[state][s]
            assert said == ("plain" if symbol == "insult" else symbol)


def test_only_patterns_beyond_chance_stand_out():
    assert toxicity.stands_out(20, 0, 100, 900) > 3
    assert toxicity.stands_out(4, 0, 500, 500) == 0
    assert toxicity.stands_out(50, 400, 100, 900) == 0


def test_learns_words_and_stems(spark):
    rows = [(i, f"plain words here number{i % 7} dronk" + chr(97 + i % 5) if i % 2 else f"plain words here zork number{i % 7}" if i % 4 else "plain words here") for i in range(600)]
    # A text of its own for each row: copies of a labelled text count once.
    rows = [(i, f"{t} w{''.join(chr(97 + int(d)) for d in str(i))}x") for i, t in rows]
    labels = [(i, int("zork" in t or "dronk" in t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grammar = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zork" in grammar.words and "dronk" in grammar.stems and "plain" not in grammar.words
    got = toxicity.score(docs, grammar).collect()
    assert all((r.score >= 0.3) == bool(labels[r.doc_id][1]) for r in got)


def test_edge_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "idiot " * 9, None)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == 4 and {r.predicted for r in got if r.doc_id is not None} == {0}
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert toxicity.judged(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op2_toxicity_grammar(spark, folder).collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in judged]) >= 0.9


def test_equal_texts_with_different_labels_are_no_witness(spark):
    """Whatever the order and partitions of the rows, the same model comes out."""
    rows = [(i, f"you are a gronk fool number {i % 40}") for i in range(0, 400, 1)] + [(1000 + i, f"a calm day number {i % 50}") for i in range(400)]
    labels = [(k, 1) for k, _ in rows[:400]] + [(k, 0) for k, _ in rows[400:]] + []
    labels[3] = (rows[3][0], 0)
    scores = set()
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        grammar = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(parts))
        scores.add((round(grammar.bias, 9), tuple(np.round(grammar.weights, 9)), tuple(sorted(grammar.words)), tuple(sorted(grammar.stems))))
    assert len(scores) == 1


def plain_score(grammar, text):
    """Word by word through the four machines one after the other, a clause at a time."""
    sums = [0.0] * len(toxicity.KINDS)
    machines = [toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.THREAT]
    states = [m.start for m in machines]
    for token in (m.group() for m in toxicity.TOKEN.finditer((text or "").lower())):
        if token in toxicity.BOUNDARY:
            states = [m.start for m in machines]
            continue
        weight = grammar.weight(token) if toxicity.WORD.fullmatch(token) else 0.0
        symbol = "insult" if weight else "quote" if token in toxicity.QUOTES else toxicity.SYMBOLS[toxicity.SYMBOL_OF.get(token, 0)]
        for i, machine in enumerate(machines):
            states[i], symbol = machine.step(states[i], symbol)
        kind = "plain" if symbol == "insult" else symbol
        if kind in toxicity.KINDS:
            sums[list(toxicity.KINDS).index(kind)] += weight or toxicity.SEED_WEIGHT
    x = sum(w * np.log1p(s) for w, s in zip(grammar.weights, sums)) + grammar.bias
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def test_scores_of_documents_against_plain_machines(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    grammar = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    insult = next(iter(toxicity.SEEDS["insult"].split()))
    own = ["", None, f"you are {insult}", f"not {insult}. you {insult}!", f'they said "{insult}" {insult}', f"I will kill you, {insult}", f"{insult} " * 50_000]
    texts |= {-1 - i: t for i, t in enumerate(own)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(frame, grammar).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        assert abs(got[key] - plain_score(grammar, text)) < 1e-9, text
