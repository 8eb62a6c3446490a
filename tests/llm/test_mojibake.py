import pytest

from metrolith.llm.mojibake import garbled_documents, inside, inside_evidence, repair_sequences, restored_documents, restored_forms, words_of
from metrolith.session import Workspace

CLEAN = [
    "A café band plays naïve music – “Lüre” isn’t modest… 45° ♩ = 120 «Gazédi» €5 ½ ±3",
    "ATENÇÃO: A SEÇÃO FINAL ESTÁ EM 2/4, NÃO EM 3/4. Ça, où, même; Úder à É…",
    "Поздний вход скрывает сильную долю. Мы приём ёлка Рёв Её «Сёмга» № 5", "Різдво Київ їжак ґанок", "Οι χορευτές μετρούν 7/8, αλλά η παρτιτούρα γράφει", "秒の休みのあと、小節番号がずれている「Vabafi」の拍",
    "Příliš žluťoučký kůň – „šest“ řádků", "Größe, ÄÖÜ, „Über“ …", "ungefär Ändra åhörarna Åke", "Şarkının güçlü vuruşu", "Zażółć gęślą jaźń", "├── a\n│   └── b\n┌─┬─┐\n├│┤", "cafe\u0301 de\u0301place\u0301 ¯\\_(ツ)_/¯ 👍🏽 🇸🇪", "line\x85end", "x" * 50_000 + "é",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert repair_sequences(text) == (text, False) and not inside_evidence(text)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", ["déjà vu à l’été", "größere Übergänge", "público, acompañó", "Привет, как дела", "Οι χορευτές μετρούν", "Těžká přišla", "小節番号がずれている", "Zażółć się"])
def test_utf8_read_as_another(text, wrong):
    raw = text.encode()
    garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)
    fixed, evident = repair_sequences("Plain words. " + garbled + " More words.")
    assert evident
    if wrong in ("latin-1", "cp1252", "cp437"):
        assert fixed == "Plain words. " + text + " More words."


def test_twice_and_mixed():
    once = "déjà".encode().decode("cp1252")
    twice = "naïve…".encode().decode("cp1252").encode().decode("cp1252")
    assert repair_sequences(f"été {once} {twice} Größe")[0] == "été déjà naïve… Größe"


def test_japanese():
    text = "小節番号がずれているので確認"
    for true, wrong in (("shift_jis", "latin-1"), ("euc_jp", "latin-1")):
        fixed, evident = repair_sequences("ok " + text.encode(true).decode(wrong))
        assert evident and fixed == "ok " + text


def test_lost_characters_are_found():
    assert repair_sequences("year\ufffds")[1] and repair_sequences("Til\x81")[1]
    assert inside_evidence("p£blico") and inside_evidence("deuxiŠme") and inside_evidence("the 45ø turn") and inside_evidence("D”re says") and not inside_evidence("“A”s")


def test_restored_forms():
    assert "přišla" in restored_forms("pøi¹la") and "голос" in restored_forms("ЦНКНЯ") and "się" in restored_forms("siê") and not restored_forms("né")


def test_signs_inside_words_are_restored(spark):
    texts = ["Zwei h\u201dren das p£blico ®la prima parte che non finisce¯ um 45ø", "Größe", "cinq ‚coles, deux p‚riodes", "x" * 70 + "®a " + "b " * 90 + "c¯"]
    fixed = {r.doc_id: r.restored for r in restored_documents(docs(spark, texts), Workspace(spark, "t")).collect()}
    assert fixed[0] == "Zwei hören das público «la prima parte che non finisce» um 45°" and 1 not in fixed and "périodes" in fixed[2] and fixed[3].endswith("c»")


def test_marks_figures_and_lost_hyphens():
    import unicodedata

    text = unicodedata.normalize("NFD", "a segunda gravação repete")
    assert repair_sequences(text.encode().decode("mac-roman")) == (text, True)
    assert repair_sequences("keep the 45° copy".encode().decode("cp437")) == ("keep the 45° copy", True)
    assert inside().restored("padrões rÃtmicos") == "padrões rítmicos" and inside_evidence("rÃtmicos")
    assert inside().restored("®休み ¯\\_(ツ)_/¯") == "®休み ¯\\_(ツ)_/¯" and not inside_evidence("SEÇÃO ÃÉ ®x /¯")


def test_texts_garbled_many_times():
    text = "naïve…"
    for _ in range(6):
        text = text.encode().decode("latin-1")
    assert repair_sequences("ok " + text) == ("ok naïve…", True)


def test_texts_that_the_prefilter_passes_over_have_no_evidence():
    import random

    from metrolith.llm.mojibake import automaton

    auto, rnd = automaton(), random.Random(1)
    pool = [c for t in CLEAN for c in t[:60]] + [t.encode().decode("cp1252", "replace") for t in ("déjà", "größe", "“x”", "смысл", "…")] + ["Ã", "©", "â", "€", "Р", "С"]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(12))
        assert auto.may.search(text) or not auto.matches(text), text


def test_long_words_count():
    assert words_of("ok " + "nejneobhospodařovávatelnějšími" * 2) == ["nejneobhospodařovávatelnějšími" * 2]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", True, ["w"]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, hit boolean, words array<string>")


def test_words_by_frequency(spark):
    texts = ["Zvláštní přízvuk přišla", "Наша модель голос"] * 12 + ["pøi¹la domù", "íàøà ìîäåëü ãîëîñ", None, "", "  ", "plain", "cafÃ© x", "pøi¹la\u00a0domù, «přišla» ok"]
    for t in (texts, [*texts, *texts[:2]]):
        df = docs(spark, t)
        got = {r.doc_id for r in garbled_documents(df, Workspace(spark, "t")).collect()}
        assert got == {24, 25, 30, 31}
    fixed = {r.doc_id: r.restored for r in restored_documents(docs(spark, texts), Workspace(spark, "t")).collect()}
    assert fixed[24] == "přišla domù" and fixed[25].endswith("модель голос") and fixed[30] == "café x" and fixed[31] == "přišla\u00a0domù, «přišla» ok"


def test_copies_and_garbled_sources(spark):
    clean = ["Zvláštní přízvuk přišla", "přišla řada přímo", "příběh při řece přišla došla vyšší", "přišel přišli číšník přišla šli tišší přinesl"]
    rows = [(i, clean[i % 4] + f" {i}", "ab"[i % 2]) for i in range(30)]
    copies = [(100 + i, "pøi¹la domù", "b") for i in range(40)]  # one garbled text, copied
    whole = [(200 + i, f"pøi¹la {i}", "c") for i in range(40)]  # a source garbled throughout
    foreign = [(300 + i, f"père très, ère {i}", "d") for i in range(40)]
    for bad in (copies, whole):
        df = spark.createDataFrame(rows + bad + foreign, "doc_id long, text string, source string")
        assert {r.doc_id for r in garbled_documents(df, Workspace(spark, "t")).collect()} == {r[0] for r in bad}
        fixed = {r.doc_id: r.restored for r in restored_documents(df, Workspace(spark, "t")).collect()}
        assert set(fixed) == {r[0] for r in bad} and all(v.startswith("přišla") for v in fixed.values())


def test_empty(spark):
    assert garbled_documents(docs(spark, ["x"]).limit(0), Workspace(spark, "t")).count() == 0
