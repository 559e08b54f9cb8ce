"""Texts that the checks write into their result columns, and default parameters."""

MATCHED = "Eşleşti"
LOOKED_AT = "Kontrol edildi"
COMBINED_COLUMN = "Birleşik Kolon"
ROW_SUM_COLUMN = "Satır Toplamı"
ROW_DIFF_COLUMN = "Satır Farkı"

LOW, MEDIUM, HIGH, CRITICAL = "Düşük", "Orta", "Yüksek", "Kritik"

COLUMNS_COMPARED = "Kolonlar karşılaştırıldı"
SPLIT_DONE = "Borç/Alacak kolonları hesaplandı"
DUPLICATE, SINGLE = "Duplicate", "Benzersiz"
BAD_DOCUMENT = "Bos veya mukerrer belge numarasi"
SINGLE_LEG = "Tek bacakli fis"
SAME_PERSON = "Olusturan ve onaylayan ayni"
USER_INTENSITY = "Kullanici yogunluk analizi"
OUTSIDE_EXPECTED = "Beklenen karşı hesap dışında çalışma"
RISK_NOTE = "Otomatik risk skoru"

REASONS = {
    "special_chars_description": "Ozel karakter kontrolu",
    "words": "Kelime listesi kontrolu",
    "high_amount": "Yuksek tutar",
    "amount_between": "Tutar araligi",
    "date_set": "Tarih listesi",
    "month_end": "Ay sonu",
    "year_end": "Yil sonu",
    "date_range": "Tarih araligi",
    "account_range": "Hesap kodu araligi",
    "after_hours_high_amount": "Mesai disi yuksek tutar",
    "empty": "Boş/dolu değer kontrolü",
    "negative": "Negatif tutar",
    "zero": "Sıfır/tolerans kontrolü",
    "weekend": "Hafta sonu tarih",
    "period_end": "Dönem sonu aralığı",
    "date_between": "Belirli tarih aralığı",
    "after_hours": "Mesai dışı kayıt",
    "short_text": "Kısa açıklama",
    "exclude_opening": "Açılış/devir kaydı hariç tutuldu",
    "account_codes": "Hesap kodu eşleşmesi",
    "suspicious_keywords": "Şüpheli anahtar kelime",
    "generic_system_user": "Generic/sistem kullanıcısı",
}

BLANK_PLACEHOLDERS = ["null", "n/a", "na", "none", ".", "-", "/", "?", "***"]
MANUAL_WORDS = ["manuel", "manual", "MNL"]
SPECIAL_CHARACTERS = r"[^a-zA-Z0-9ığüşöçİĞÜŞÖÇ\s.,;:!?/\-]"
OPENING_WORDS = ["acilis", "açılış", "devir", "opening"]
SUSPICIOUS_WORDS = [
    "düzeltme", "correction", "manuel", "manual", "bonus", "ikramiye", "hediye", "gift", "acil", "urgent", "özel",
    "fark", "adjustment", "misc", "miscellaneous", "diğer", "geçici", "avans", "emanet", "iptal", "geri ödeme",
]
GENERIC_USERS = ["admin", "administrator", "system", "service", "sa", "root", "test", "user", "generic"]
RISK_USERS = ["admin", "system", "service", "root", "test", "generic"]
MAIN_ACCOUNTS = ["600", "601", "602", "610", "611"]
EXPECTED_ACCOUNTS = [
    "100", "101", "102", "120", "121", "127", "150", "153", "157", "181", "281", "320", "380", "391", "480", "620",
    "646", "654", "689", "710", "712", "720", "721", "730", "731", "760", "770", "771", "800",
]
AMOUNT_NAMES = ["tutar", "amount", "borc", "alacak"]
