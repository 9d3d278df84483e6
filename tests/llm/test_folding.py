"""Benchmark passages in capitals of any alphabet are found."""

from barline.llm import decontam


def test_capitals_of_other_alphabets(spark):
    items = [
        (1, "où l'élève âgé répète à côté où même la forêt brûlée gêne l'été près du château très éloigné"),
        (2, "ñandú señal mañana niño año pequeño otoño sueño daño baño caña leña piña viña"),
        (3, "straße größe weiß groß süß heiß fuß gruß spaß maß"),
        (4, "καλημέρα κόσμος άνθρωπος δρόμος λόγος ουρανός θάλασσα πόλεμος ειρήνη"),
        (5, "đường phố việt nam rất đẹp và người dân ở đây thật là hiền lành tốt bụng"),
    ]
    around = " ".join(f"plain{k % 37} text{k % 23}" for k in range(60))
    texts = [(i, f"{around} {t.upper()} {around}") for i, t in items] + [(10 + i, f"{around} {t} {around}") for i, t in items]
    texts += [(20, around), (21, "É Ñ ẞ Σ Đ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs_ratio"] for r in decontam.leaks(docs, bench).collect()}
    assert got == {(i + k, i): 1.0 for i, _ in items for k in (0, 10)}
