import pyarrow as pa

from voxelgrain.llm import tokens


def test_a_worker_remembers_little_beside_its_texts(monkeypatch):
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    path = tokens.tokenizer_path("word_bpe_49k.json")
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(str(1_000_000 + 1000 * i + k).translate(letters) for k in range(1000)) for i in range(450)]
    lots = list(tokens.encode_column(path, pa.array(texts)))
    assert sum(len(sizes) for _, _, sizes in lots) == len(texts)
    assert all(texts[at : at + len(sizes)] and sum(map(len, texts[at : at + len(sizes)])) <= 1_000_000 for at, _, sizes in lots)
    assert len(tokens.encoder(path).known) < 350_000
    got = [ids[: sizes[0]].tolist() for _, ids, sizes in lots]
    for (at, _, _), ids in list(zip(lots, got, strict=True))[:: len(lots) - 1]:
        assert ids == tokens.encoder(path).tokenizer.encode(texts[at], add_special_tokens=False).ids
