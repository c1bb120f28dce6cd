import pytest
from pyspark.sql import functions as F

from retentia.llm import mojibake as M

CLEAN = [
    "Café “très cosy” — it’s naïve… señor, smörgåsbord, jalapeño",
    "ATENÇÃO: A MEMÓRIA NÃO DEVE SER APAGADA ATÉ A REVISÃO. ÂMBITO DA REUNIÃO",
    "Tänään hyvää jäätelöä, Älä unohda; süße Äpfel, größere Käfige für die Vögel",
    "После сессии помощник забыл, что хозяин больше не живёт в доме. Где лежит ключ? Ещё зимой.",
    "reads ÄÖÜ-49 / Ñ-58; wrote √53 ≈ 92 ± 2, α = 0.76, Δ ≤ 1, │ 49 °C │ 32 ½ │, paid £51 or €11 or ¥77",
    "offers 餃子 and ラーメン, said “добрый вечер” to 猫", "├── tree\n│   └── leaf", "плохо: НЕ УДАЛЯТЬ ДО ВЕСНЫ", "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_is_left_alone(text):
    assert M.repair(text) == (text, 0, 0, False)


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "cp1250", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", CLEAN[:1] + CLEAN[2:4])
def test_whole_texts_come_back(text, encoding):
    garbled = M.sloppy(text.encode("utf-8"), encoding)
    whole, n, lost, found = M.repair(garbled)
    assert found and n and not lost
    assert whole == text


def test_double_and_mixed():
    once = M.sloppy("fiancée’s café".encode(), "cp1252")
    twice = M.sloppy(once.encode(), "cp1252")
    assert M.repair(f"señor {twice} größer")[0] == "señor fiancée’s café größer"


def test_cyrillic_single_byte_encodings():
    text = "Где лежит ключ от сарая? Кажется, Дорвин оставил его на полке."
    for true, assumed in (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "latin-1")):
        assert M.repair(text.encode(true).decode(assumed))[0] == text


def test_chinese_reading_and_losses():
    assert M.repair("Se帽or at the caf茅")[0] == "Señor at the café"
    assert M.repair("it鈥檚 here")[0] == "it’s here"
    assert M.repair("s��e �pfel")[2:] == (3, True)


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "café"), (5, "cafÃ©"), (5, "cafÃ©"), (6, "é" * 30000 + " naÃ¯ve")]
    df = spark.createDataFrame(rows, "restored int, text string")
    got = [(r["restored"], r["n_replaced"]) for r in M.find_garbled(df, [F.col("restored")], F.col("text"), restore=False).collect()]
    assert sorted(got) == [(5, 1), (5, 1), (6, 1)]
    assert M.find_garbled(df.limit(0), [F.col("restored").alias("k")], F.col("text")).count() == 0
    back = M.find_garbled(df, [F.col("restored").alias("k")], F.col("text"))
    assert {r["restored"] for r in back.where("k = 5").collect()} == {"café"}


@pytest.mark.parametrize("text", ["Ћирилица", "Ђорђе и Љубица у Новом Саду", "Привіт як справи сьогодні", "Це ціні в Україні ніколи, Рік Січ", "Българският език е хубав", "Καλημέρα κόσμε", "ääni öölätti", "5 m³ a day, 10 km² wide"])
def test_other_languages_are_left_alone(text):
    assert M.restored(text) == (text, {})


def test_any_number_of_wrong_decodings():
    text = "café"
    for _ in range(6):
        text = M.sloppy(text.encode(), "latin-1")
    assert M.repair(text)[0] == "café"


OTHER_PAIRS = [
    ("привет", "cp1251", "latin-1"), ("Привет, как дела", "koi8-r", "latin-1"), ("Καλημέρα κόσμε", "cp1253", "latin-1"), ("Καλημέρα κόσμε", "iso8859-7", "cp1252"),
    ("Zażółć gęślą jaźń", "cp1250", "cp1252"), ("Zażółć gęślą jaźń", "iso8859-2", "latin-1"), ("こんにちは", "shift_jis", "cp1252"), ("안녕하세요", "euc_kr", "latin-1"),
    ("中国人民在这里", "gbk", "cp1252"), ("Straße", "cp1252", "cp850"), ("Fuß da", "cp1252", "cp850"), ("größere Käfige für", "mac_roman", "cp1252"), ("größere Käfige für", "cp850", "cp1252"),
]


@pytest.mark.parametrize("text,true,assumed", OTHER_PAIRS)
def test_other_pairs_come_back(text, true, assumed):
    assert M.repair(M.sloppy(text.encode(true), assumed))[0] == text


def test_lost_no_break_space():
    assert M.repair("a pizza Ã la carte")[0] == "a pizza à la carte"


def test_paths_are_told_apart():
    assert M.restored("cafÃ©")[1] == {"utf": 1} and M.restored("ïðèâåò")[1] == {"high": 1} and M.restored("s�")[1] == {"lost": 1}
