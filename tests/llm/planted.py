"""Texts in many scripts, garbled on purpose: ``python -m tests.llm.planted`` prints what is found and restored per pair of encodings."""

from __future__ import annotations

import random
from collections import defaultdict

from quire.llm import mojibake as M

# Words by language; each needs an encoding of its own besides UTF-8.
WORDS = {
    "french": "référence élément été déjà façon où cœur hôte être sûr données créé échoue numéro modifié à noël garçon",
    "german": "Größe ändert Schlüssel während für Straße löschen nächste zurück Rückgabe müssen Zähler heißt öffnen schließen",
    "polish": "pamięć część gałąź źródło być żądanie środek łącze usuń również więcej ścieżka błąd między zmień następny",
    "czech": "čtení výstup řádek žádný můžeme příkaz paměť ještě změna než klíč šířka překlad chyba uložit není",
    "turkish": "değişiklik için çözüm açık kayıt ışık şimdi güncelleme bağlantı öğe yığın geçici sınır değer boş",
    "russian": "память чтение удалить ошибка строка файл очередь поиск ветка данные проверка добавить запрос таблица размер",
    "ukrainian": "пам’ять читання їжак помилка рядок файл черга пошук гілка дані перевірка додати запит ґрунт розмір",
    "greek": "μνήμη ανάγνωση σφάλμα γραμμή αρχείο ουρά αναζήτηση κλάδος δεδομένα έλεγχος προσθήκη ερώτημα πίνακας μέγεθος",
    "hebrew": "זיכרון קריאה שגיאה שורה קובץ תור חיפוש ענף נתונים בדיקה הוספה שאילתה טבלה גודל",
    "arabic": "ذاكرة قراءة خطأ سطر ملف طابور بحث فرع بيانات فحص إضافة استعلام جدول حجم",
    "thai": "หน่วยความจำ อ่าน ผิดพลาด บรรทัด ไฟล์ คิว ค้นหา สาขา ข้อมูล ตรวจสอบ เพิ่ม คำถาม ตาราง ขนาด",
    "vietnamese": "bộ nhớ đọc lỗi dòng tệp hàng đợi tìm kiếm nhánh dữ liệu kiểm tra thêm truy vấn bảng kích thước",
    "japanese": "設定を変わる 検索エラー 更新ファイル テストを分割 順序がファイル 読み込みの修正 処理を削除 結果画面の キャッシュ更新 表示設定を",
    "chinese": "更新文件设置 删除错误处理 搜索结果页面 读取配置数据 修改分支测试 添加缓存功能 检查查询表格 增加显示大小",
    "korean": "메모리 읽기 오류 파일 대기열 검색 브랜치 데이터 검사 추가 질의 테이블 크기 설정을 변경",
    "symbols": "a—b “quoted” it’s ≥5 ≤7 →next ✓done 😀ok 🚀go €5 …more",
}
OWN = {
    "french": ("cp1252", "cp850", "mac_roman"), "german": ("cp1252", "cp437", "cp850", "mac_roman"), "polish": ("cp1250", "iso8859-2", "cp852"), "czech": ("cp1250", "iso8859-2", "cp852"),
    "turkish": ("cp1254",), "russian": ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"), "ukrainian": ("cp1251", "koi8-u"), "greek": ("cp1253", "iso8859-7"),
    "hebrew": ("cp1255",), "arabic": ("cp1256",), "thai": ("cp874",), "vietnamese": (), "japanese": ("shift_jis", "euc_jp"), "chinese": ("gbk", "big5"), "korean": ("euc_kr",), "symbols": (),
}
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "cp1253", "cp1255", "cp1256", "cp932", "gbk", "big5", "euc_kr")
DECOYS = [
    "├── src\n│   ├── a.py\n│   └── b.py", "NÃO AÇÃO ÂNCORA", "5 × 3 ± 2 ½ µs 20°C §4", "Рёбра СССР «СССР» Сёмга её идёт", "Úžasný Öş Češi ÓŚ", "— Édition —Über ‚Äpfel‘", "«CAFÉ» “CAFÉ” SYÖDÄ» ACCIÓN…",
    "Снежана Сњежана грађа РС…", "رک سگ دگ پ", "รฉรกท้อง", "ΓΌ ΆΈ Έλα", "ôî ïà ñò êî",
]


def line(r: random.Random, language: str) -> str:
    words = WORDS[language].split(" ")
    glue = "" if language in ("japanese", "chinese", "thai") else " "
    return glue.join(r.choice(words) for _ in range(8))


def corpus(seed: int = 1, sound: int = 60, bad: int = 2):
    """([(doc_id, text)], {doc_id: (pair or None, original)}): sound texts and decoys, and texts with a garbled line for each pair that changes it."""
    r = random.Random(seed)
    docs: list[tuple[int, str]] = []
    truth: dict[int, tuple] = {}

    def put(text, pair=None, original=None):
        truth[len(docs)] = (pair, original or text)
        docs.append((len(docs), text))

    for language in WORDS:
        for _ in range(sound):
            put("\n".join(line(r, language) for _ in range(3)))
        for true in ("utf-8", *OWN[language]):
            for wrong in READ_AS:
                for _ in range(bad):
                    good, other = line(r, language), line(r, language)
                    g = M.garble(good, true, wrong)
                    if g is not None and not g.isascii():
                        put(f"head\n{g}\n{other}", (language, true, wrong), f"head\n{good}\n{other}")
    for text in DECOYS * 2:
        put(text)
    return docs, truth


def measure(found: dict[int, str | None], truth: dict[int, tuple]):
    """({pair: [documents, found, restored]}, sound documents that were found)."""
    out: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    wrong = []
    for doc, (pair, original) in truth.items():
        if pair is None:
            if doc in found:
                wrong.append(doc)
            continue
        row = out[pair]
        row[0] += 1
        row[1] += doc in found
        row[2] += found.get(doc) == original
    return out, wrong


if __name__ == "__main__":
    from quire.session import build

    docs, truth = corpus()
    spark = build("planted", "local[4]", **{"spark.ui.showConsoleProgress": "false"})
    got = {r.doc_id: r.repaired for r in M.garbled(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()}
    table, wrong = measure(got, truth)
    for pair, (n, a, b) in sorted(table.items()):
        print(*pair, n, round(a / n, 2), round(b / n, 2))
    n, a, b = (sum(x[i] for x in table.values()) for i in range(3))
    print("all", n, round(a / n, 3), round(b / n, 3), "pairs under 0.9 found:", sum(x[1] < 0.9 * x[0] for x in table.values()), "restored:", sum(x[2] < 0.9 * x[0] for x in table.values()), "of", len(table), "sound found:", [docs[d][1] for d in wrong])
