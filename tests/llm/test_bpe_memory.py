"""The encoder's memory: two workers have to fit beside an executor's heap."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
from clauseloom.llm import bpe
from tokenizers import Tokenizer

GROWTH = """
import re, sys
import pyarrow as pa
from clauseloom.llm import bpe

def now(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

batches = pa.ipc.open_stream(open(sys.argv[1], "rb")).read_all().to_batches()
encoder = bpe._encoder(bpe.public_path(), bpe.LEAF)
open("/proc/self/clear_refs", "w").write("5")
before = now("VmRSS")
for batch in batches:
    for found in encoder.encode(batch.column(0)):
        pass
print(now("VmHWM") - before, len(encoder.table))
"""


def library(text):
    t = Tokenizer.from_file(bpe.public_path())
    ids = t.encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), t.decode(ids, skip_special_tokens=False)


def test_memory_of_a_worker(tmp_path):
    rng = random.Random(7)
    part = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu", "an", "er", "on", "st"]
    word = ["".join(rng.choices(part, k=rng.randint(1, 5))) for _ in range(600_000)]
    batches = [pa.RecordBatch.from_pydict({"t": [" ".join(rng.choices(word, k=500)) for _ in range(3000)]}) for _ in range(3)]
    with pa.OSFile(f"{tmp_path}/texts", "wb") as f, pa.ipc.new_stream(f, batches[0].schema) as w:
        for batch in batches:
            w.write_batch(batch)
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    said = subprocess.run([sys.executable, "-c", GROWTH, f"{tmp_path}/texts"], capture_output=True, text=True, check=True, timeout=300, env=env).stdout
    grown, pieces = map(float, said.split())
    assert grown < 160 and pieces <= 2 * bpe.TABLE, said


def test_table_keeps_what_recurs(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "CHUNK", 4000)
    common = [f"known{i}x" for i in range(300)]
    texts = [" ".join(rng.sample([*common, *(f"once{k}y{i}" for i in range(200))], 500)) for k in range(30)]
    encoder = bpe.TreeBPE(bpe.public_path(), table=400)
    got = [(a, b) for _, ids, decoded in encoder.encode(pa.array(texts)) for a, b in zip(ids.to_pylist(), decoded.to_pylist(), strict=True)]
    assert got == [library(t) for t in texts]
    for _ in range(2):
        encoder.known([w.encode() for w in common])
    encoder.forget()
    assert len(encoder.table) == 200


def test_text_of_several_chunks():
    rng = random.Random(9)
    words = ["the", "Erst", "naïve", "日本", "it's", "x1", "<|endoftext|>", "and,", "q" * 1500, "\n", "\t"]
    text = " ".join(rng.choices(words, weights=[9, 9, 5, 5, 5, 5, 1, 5, 0.01, 2, 1], k=600_000))
    assert len(text.encode()) > 2 * bpe.CHUNK
    (n, ids, decoded), = bpe._encoder(bpe.public_path(), bpe.LEAF).encode(pa.array([text]))
    assert (n, ids[0].as_py(), decoded[0].as_py()) == (1, *library(text))
