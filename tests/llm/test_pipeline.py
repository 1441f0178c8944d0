"""The pipeline against its stages done plainly, and the registry."""

import base64
import re

import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_duplicates import plain_classes
from tests.llm.test_native import plain_targets
from tidemark.llm import mixing, pii, toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run_is_what_the_stages_say(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    score = dict(zip(rows, model.score([r.text for r in rows.values()])))
    clean = [(i, r.text) for i, r in rows.items() if score[i] < 0.5]
    kept = sorted(set(plain_classes(clean).values()))
    masked = {r.doc_id: r for r in pii.redact(docs.where(docs.doc_id.isin(kept))).collect()}
    sizes = {}
    for r in masked.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(mixing.WORD, r.text))
    target = plain_targets(sizes)
    chance = {r[0]: r[1] for r in docs.select("doc_id", mixing.draw(docs.doc_id, docs.text)).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = []
    for i, r in masked.items():
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        want += [(i, encode(r.text))] * (int(rate) + (chance[i] < rate - int(rate)))
    got = [(r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_stages_keep_columns_and_take_awkward_rows(spark, awkward, empty):
    docs = {"some": awkward, "none": empty}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for key, df in docs.items():
            docs[key] = stage(spark, df, SF)
            assert docs[key].columns == awkward.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs["some"], SF).count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs["none"], SF).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
