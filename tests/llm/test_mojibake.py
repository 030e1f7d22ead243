import pytest

from threadloom.llm import mojibake as mb

CLEAN = [
    "Der Lösungsvorschlag löscht überflüssige Einträge und räumt Verzeichnisse auf. Größe prüfen.", "Según el análisis el tamaño máximo debería ser 19 páginas. Después del cambio, la función devolvió más.", "Où as-tu vérifié que le délai dépassé ne bloque pas la tâche précédente ? Voilà l’été.",
    "A função não deve ser chamada antes da migração; exceção não tratada no último relatório.", "Проверь, пожалуйста, почему индекс обновляется дважды при каждом запуске. Команда решила отложить миграцию.", "請幫我看看為什麼索引在每次啟動時都會重建兩次。這個版本新增了設定選項，預設值都維持不變。", "テスト環境では再現しませんが、本番では応答が遅くなります。利用者からの報告です。",
    "It’s the router’s own cache, not ours – see “brittle” above… total cost ≈ 14 × 246 ✓ → µs (±5 %).", "The dictionary keeps ÎLE, ÂGE, CRÊPE, Ångström and SÃO as they are. ATENÇÃO: IRMÃO.", "├── src\n│   └── main.py", "plain ascii", "",
]


@pytest.fixture(scope="module")
def stats(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CLEAN * 6)], "doc_id bigint, text string")
    return (mb.Judge(*mb.character_statistics(df)),)


def test_clean_texts_are_left_alone(stats):
    for t in [*CLEAN, None, "a `Ã©` or `â€™` as an example", "x" * 100_000 + "é"]:
        assert mb.restore(t, *stats) == (t or "", []), t


@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp850"])
def test_utf8_read_as_a_single_byte_page_is_restored(stats, codec):
    for t in CLEAN[:3] + CLEAN[7:8]:
        try:
            broken = t.encode().decode(codec)
        except UnicodeDecodeError:
            continue
        out, found = mb.restore(broken, *stats)
        assert out == t and found


def test_single_lines_and_double_decoding(stats):
    broken = CLEAN[0].encode().decode("cp1252").encode().decode("cp1252", "replace")
    out, found = mb.restore(f"fine: été\n{broken}\nlast", *stats)
    assert out.split("\n")[0] == "fine: été" and out.split("\n")[1] == CLEAN[0] and found


@pytest.mark.parametrize(
    ("read", "written", "k"),
    [("cp850", "latin-1", 1), ("cp1251", "latin-1", 2), ("cp1251", "koi8_r", 4), ("koi8_r", "cp1251", 4)],
)
def test_one_page_read_as_another(stats, read, written, k):
    broken = CLEAN[k].replace("’", "'").encode(written).decode(read)
    out, found = mb.restore(broken, *stats)
    assert found and out == CLEAN[k].replace("’", "'")


@pytest.mark.parametrize(("codec", "k"), [("gb18030", 5), ("cp950", 5), ("cp932", 6)])
def test_multibyte_mixups_are_found(stats, codec, k):
    assert mb.restore(CLEAN[k].encode().decode(codec, "replace"), *stats)[1]
    out, found = mb.restore(CLEAN[k].encode(codec).decode("latin-1"), *stats)
    assert found == ["bytewise"]


def test_lost_characters_count_and_examples_do_not(stats):
    assert mb.restore("informa��o", *stats)[1] == ["lost"]
    assert mb.restore("shows `�` when broken", *stats)[1] == []
    out, found = mb.restore("`Ã©` then " + "é".encode().decode("cp1252"), *stats)
    assert out == "`Ã©` then é" and found


def test_automaton_takes_maximal_spans_only():
    out, share = mb.decode_spans("caf" + "é".encode().decode("cp1252") + " SÃO", "cp1252")
    assert out == "café SÃO" and 0.5 <= share < 1


def test_repair_rows(spark):
    rows = [
        (1, "été".encode().decode("cp1252"), "clash", 0),
        (2, None, None, None),
        (3, "", "x", 1),
        (1, "été".encode().decode("cp1252"), "again", 2),
        (4, "clean é", "", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, how string, row_id int")
    assert sorted(tuple(r) for r in mb.repair(df).collect()) == [(1, "été", "utf-8 as cp1252")] * 2
    assert mb.repair(df.limit(0)).count() == 0


SCRIPTS = {"he": "שלום עולם זה טקסט", "th": "สวัสดีชาวโลก", "hi": "नमस्ते दुनिया", "vi": "Tiếng Việt rất đẹp và phức tạp", "ar": "مرحبا بالعالم", "el": "Καλημέρα κόσμε", "ko": "안녕하세요 세계"}


@pytest.mark.parametrize("codec", ["cp1252", "cp850", "cp437", "mac_roman"])
@pytest.mark.parametrize("script", SCRIPTS)
def test_scripts_that_the_corpus_lacks_are_restored(stats, script, codec):
    text = SCRIPTS[script]
    holes = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
    broken = "".join(chr(b) if codec == "cp1252" and b in holes else bytes([b]).decode(codec) for b in text.encode())
    assert mb.restore(broken, *stats)[0] == text


def test_a_span_counts_whatever_else_its_line_holds(stats):
    out, found = mb.restore("Ein Fehler für alle 日本語日本語 caf" + "é".encode().decode("cp1252"), *stats)
    assert out == "Ein Fehler für alle 日本語日本語 café" and found == ["utf-8 as cp1252"]


def test_rare_but_clean_lines_are_left_alone(stats):
    for t in ["noms: éèêëàâ fin", "так что чай шли", "«группаВ» и «В»", "“École” — À bientôt", "Ångström ÄÖÜ äöü ß"]:
        assert mb.restore(t, *stats) == (t, []), t


def test_dense_bytes_that_no_page_explains_are_reported_as_not_restored(stats):
    out, found = mb.restore("²Ä\x81¦¸\x8f°õ\x90¦æ¥¢±Ñ\x9d¡A¦]¬", *stats)
    assert found and out
