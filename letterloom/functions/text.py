"""String functions as Column expressions.

White space is Unicode white space with the separators of the C0 block, word characters are letters, digits and the
underscore of any script; both are spelled out as classes, so that they mean the same on every JVM and in other engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NON_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

# Patterns, markers and words that results depend on.
ANY_MARKER = r"\[[A-ZА-ЯЁ_]+\]"
KNOWN_MARKERS = (
    "FINANCIAL_DATA", "FINANCИAL_DATA", "ORGANIZATION", "PERSON", "LOCATION", "CONTACT", "ID", "OBJECT", "DOCUMENT_NUMBER",
    "DOCUMENT_TYPE", "DATE", "DATE_TIME", "NUMBER", "YEAR", "DESCRIPTION", "POSITION", "TYPE", "WORK_TYPE", "DOMAIN",
    "WEBSITE", "ZIP_CODE", "COUNTRY", "SNAB", "ENGINE_MODEL", "REGIONAL_OFFICE", "CODE", "OKPO", "OGRN", "INN", "KPP",
    "REGION", "NAME", "PLANT", "MUNICIPAL_DISTRICT", "STREET", "NEIGHBORHOOD", "ORGANIZATION_ID", "TAX_ID",
    "PHONE_PROVIDER", "EXECUTIVE_DIRECTOR",
)
KNOWN_MARKER = r"\[(?:" + "|".join(KNOWN_MARKERS) + r")\]"
POINTS_HEADER = r"\bа\s+именно\s+следующ(?:их|ие)\s+точ(?:ек|ки)\s*:"
POINTS_ITEM = r"(?:^|\s)\d{1,3}\s*[.)]\s+"
POINTS_END = r"\bначиная\s+с\s+момента\s+времени\b|\bкроме\s+того\b|\bтакже\s+сообща(?:ю|ем)\b|\bприложени[ея]\s*:"
TRANSFER_BLOCK = r"\bупд\s*(?:no|№)\s*\[DOCUMENT_NUMBER\](?:/\d+)?\s*от\s*\[DATE(?:_TIME)?\]\b"
FINANCE_DATE = r"\[(?:FINANCIAL_DATA|FINANCИAL_DATA)\]\s*\[DATE(?:_TIME)?\]"
ATTACHMENT_WORDS = ("приложени[ея]", r"ведомость\s+мтр", "спецификаци[яи]", r"счет\s+на\s+оплату", r"расчет\s+стоимости")
LIST_ITEM = r"(?:\d{1,4}\s*[.)]|\d{1,4}\s*[-–—]|[-•*]\s+|no\.?\s*\d{1,4}\b|№\s*\d{1,4}\b)"
FORMAL_WORDS = ("ОГРН", "ОКПО", "ОКТМО", "ОКВЭД", "ИНН", "КПП", "БИК", "р/с", "к/с")
DROPPED_PLACEHOLDERS = ("ORGANIZATION", "PERSON", "DATE", "LOCATION", "ID", "CONTACT", "NUMBER", "POSITION", "DOCUMENT_NUMBER")

#: Unicode-aware case folding and classes for the patterns above that use \b, \s or mixed case.
_U = "(?iuU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: elsewhere a lambda computes an outer expression for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def norm_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def tokens(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def marker_ratio(c: Column) -> Column:
    """Markers by number of parts; markers that touch count each, so it may exceed one. 0 without parts."""
    return let(F.size(tokens(c)), lambda n: F.when(n > 0, F.regexp_count(c, F.lit(ANY_MARKER)) / n).otherwise(F.lit(0.0)))


def content_tokens(c: Column) -> Column:
    return F.size(F.filter(tokens(c), lambda x: ~x.rlike(f"^{ANY_MARKER}$")))


def content_ratio(c: Column) -> Column:
    n = F.size(tokens(c))
    return F.when(n > 0, content_tokens(c) / n).otherwise(F.lit(0.0))


def compress_points(c: Column) -> Column:
    """The numbered items after the header of a list of points become one marker, up to the closing phrase or the end."""

    def compressed(c: Column) -> Column:
        head = F.regexp_extract(c, f"{_U}(?s)^.*?{POINTS_HEADER}", 0)
        tail = F.substring(c, F.length(head) + 1, F.length(c))
        after = F.regexp_extract(tail, f"{_U}(?s)(?:{POINTS_END}).*$", 0)
        listed = tail.rlike(f"(?U)(?s){POINTS_ITEM}")
        return F.when(c.rlike(f"{_U}{POINTS_HEADER}") & listed, F.concat(head, F.lit(" [POINTS_LIST] "), after)).otherwise(c)

    return let(F.coalesce(c, F.lit("")), compressed)


def truncate_attachments(c: Column) -> Column:
    """Everything from the first attachment word on becomes one marker."""
    word = rf"{_U}(?s)\b(?:{'|'.join(ATTACHMENT_WORDS)})\b"

    def truncated(c: Column) -> Column:
        prefix = F.regexp_replace(F.regexp_replace(c, word + ".*$", ""), f"{WS}+$", "")
        cut = F.concat(prefix, F.lit(" [ATTACHMENTS]"))
        return F.when(c.rlike(word), F.when(prefix == "", F.lit("[ATTACHMENTS]")).otherwise(cut)).otherwise(c)

    return let(F.coalesce(c, F.lit("")), truncated)


def remove_requisites(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), f"{_U}{TRANSFER_BLOCK}", " ")
    return norm_space(F.regexp_replace(c, f"{_U}{FINANCE_DATE}", " "))


def preprocess_text(c: Column) -> Column:
    c = F.regexp_replace(c, "[-=_*]{5,}", "—")
    c = F.regexp_replace(c, r"[.\t-\r\x1c-\x20\x{85}\p{Z}]{5,}", " ")
    return strip(F.regexp_replace(c, f"{WS}{{2,}}", " "))


def clean_aug_result(c: Column) -> Column:
    for mark in (",", ".", "!", "?"):
        c = F.regexp_replace(c, f"[{mark}]{{3,}}", mark)
    c = F.regexp_replace(c, f"{WS}+", " ")
    c = F.regexp_replace(c, " +,", ",")
    return strip(F.regexp_replace(c, ", *", ", "))


def normalize_compare(c: Column) -> Column:
    c = F.regexp_replace(strip(F.lower(c)), f"{WS}+", " ")
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}]", "")


#: Typographic signs and what they become.
TYPOGRAPHY_FROM, TYPOGRAPHY_TO = "ёЁ«»„“”‘’–—−", "еЕ\"\"\"\"\"''---"


def normalize_typography(c: Column) -> Column:
    return norm_space(F.translate(c, TYPOGRAPHY_FROM, TYPOGRAPHY_TO))


def simple_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), f"{NON_WORD}+", " "), " "), lambda x: x != "")


def drop_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\[(?:" + "|".join(DROPPED_PLACEHOLDERS) + r")\]", " ")


def dedup_key(label: Column, text: Column) -> Column:
    return F.concat(label, F.lit("|||"), F.lower(strip(F.coalesce(text, F.lit("")))))


def split_sentences(c: Column) -> Column:
    """Parts after which a full stop, exclamation or question mark and white space stand."""
    parts = F.split(F.regexp_replace(c, f"([.!?]){WS}+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def first_n_sentences(c: Column, n: int) -> Column:
    return let(split_sentences(c), lambda s: F.when(F.size(s) > 0, F.array_join(F.slice(s, 1, n), " ")).otherwise(c))


def window_sentences(c: Column, n: int, pick: Column) -> Column:
    """n sentences in a row from a start given by a non-negative number; all if there are no more than n."""

    def window(s: Column) -> Column:
        start = F.pmod(pick, F.greatest(F.lit(1), F.size(s) - n + 1)).cast("int")
        return F.when(F.size(s) == 0, c).when(F.size(s) <= n, F.array_join(s, " ")).otherwise(F.array_join(F.slice(s, start + 1, F.lit(n)), " "))

    return let(split_sentences(c), window)


def drop_words(c: Column, percent: int, salt: Column) -> Column:
    """Words without punctuation; each but не and ни goes if its place and the salt hash below the percentage.

    Texts of fewer than five words stay as they are, and so do the words of one that would lose all.
    """
    words = F.filter(F.split(F.regexp_replace(c, f"{NON_WORD}+", " "), " "), lambda x: x != "")
    draw = lambda i: ((salt + i) * F.lit(2654435761)) % F.lit(4294967296) % F.lit(100)
    keep = lambda w, i: F.lower(w).isin("не", "ни") | (draw(i) >= percent)
    chosen = lambda ws: let(F.filter(ws, keep), lambda kept: F.when(F.size(kept) == 0, F.array_join(ws, " ")).otherwise(F.array_join(kept, " ")))
    return let(words, lambda ws: F.when(F.size(ws) < 5, c).otherwise(chosen(ws)))


def formality_gate(c: Column) -> Column:
    """Requisites rather than a letter: enough letters, a requisite word, and too many digits or capitals by letter."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    digits, capitals = F.regexp_count(c, F.lit(r"\p{Nd}")), F.regexp_count(c, F.lit(r"\p{Lu}"))
    word = c.rlike("|".join(FORMAL_WORDS))
    return (letters >= 80) & word & ((digits > letters * 0.35) | (capitals > letters * 0.55))


def length_ratio_gate(source: Column, made: Column, kind: str, least: float, most: float) -> Column:
    """Whether the length of a made text suits its source; short and long sources of paraphrases have own minimums."""
    n = F.length(source)
    low = F.lit(float(least))
    if kind == "paraphrase":
        low = F.when(n < 700, 0.35).when(n > 1000, F.lit(min(least * 0.9, 0.65))).otherwise(low)
    ratio = F.try_divide(F.length(made).cast("double"), n.cast("double"))
    return F.coalesce((n > 0) & (ratio >= low) & (ratio <= most), F.lit(False))


def identity_gate(source: Column, made: Column) -> Column:
    return normalize_compare(source) == normalize_compare(made)


#: Fixed value: what a placeholder looks like.
PLACEHOLDER = r"\[[^\]]+\]"


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), F.lit(1))


def mask_placeholders(c: Column) -> Column:
    """The k-th placeholder becomes <PH_k>."""
    parts = F.split(c, PLACEHOLDER, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("<PH_"), (i - 1).cast("string"), F.lit(">"), x))), "")


def unmask_placeholders(c: Column, originals: Column) -> Column:
    """Puts the originals back, drops what is left of damaged masks and tidies the spaces."""
    text = let(originals, lambda o: F.array_join(F.transform(F.split(c, "<PH_", -1), lambda x, i: F.when(i == 0, x).otherwise(_restored(x, o))), ""))
    rest = r"https?://[Pp][Hh][_\-\s]*\d+|<\s*[Pp][Hh][_\-\s]*\d+\s*>|\b[Pp][Hh][_\-\s]*\d+\b"
    text = F.regexp_replace(F.regexp_replace(text, f"(?U){rest}", ""), f"{WS}+", " ")
    return strip(F.regexp_replace(text, " +([,.;:!?])", "$1"))


def _restored(part: Column, originals: Column) -> Column:
    number = F.regexp_extract(part, "^([0-9]{1,9})>", 1)
    original = F.get(originals, F.try_to_number(number, F.lit("999999999")).cast("int"))
    return F.when((number != "") & original.isNotNull(), F.concat(original, F.substring(part, F.length(number) + 2, F.length(part)))).otherwise(F.concat(F.lit("<PH_"), part))


def drop_latin_short_lines(c: Column) -> Column:
    """Blank lines and lines of at most 40 characters without Cyrillic go; the others are joined by spaces."""
    lines = F.transform(split_lines(c), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x.rlike("[А-Яа-я]") | (F.length(x) > 40))), " ")


def dedup_repeated_tokens(c: Column) -> Column:
    """Labels and words repeated in a row become one."""
    c = F.regexp_replace(c, r"(?U)\b(\w+:\s*)(\1)+", "$1")
    return F.regexp_replace(c, r"(?U)\b(\w+)(?:\s+\1\b)+", "$1")


#: Line breaks as Python's splitlines knows them.
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def split_lines(c: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), LINE_BREAK + r"\z", ""), LINE_BREAK, -1)


# What generators leave in texts, in the order in which it is removed, with its replacement.
GENERATED_NOISE = (
    (r"https?://\S+", ""),
    (r'(?iu)\b(?:href|src|class|id|style|data-[\w\-]+|ref)\s*=\s*"(?:[^"]{0,80})"', " "),
    (r"(?iu)\b(?:тел(?:ефон)?|тел\.?|e[\-\s]?mail|mail|факс|fax|адрес|эл\.?\s*почта|бухгалтерия\s+тел|пто\s+тел)\s*:[\s,;.]*", ""),
    (r"(?iu)\b(?:и|или)\s*:\s*(?=[,;.!\s]|$)", ""),
    (r"(?iu)(?:должность|контактный телефон|контакт)\s*:\s*[-—]*\s*", ""),
    (r"(?:[ЩщЪъЫы]\s+){2,}|[♪♫♬♩✓✗→←↑↓]|\{\s*[><!]|[#<>]\s*[><!]?|\[\s*\]|\*\s*\.?\s*", " "),
    (r"\s*[.\-–—/\\]{2,}\s*|\s*[.\-–—/\\\d]{3,}\s*", " "),
    (r"(?:\s*[^\w\s]\s*){3,}", " "),
    (r"\(\s*\)", " "),
    (r"\b([А-ЯЁа-яёA-Za-z]{1,3}\.)\s+\1\b", "$1"),
    (r"([,.;:!?])\1+", "$1"),
    (r"<\s*[A-Za-z]{1,4}[_\-\s]*\d+\s*>|\b[A-Z]{1,3}[HPh][_\-]?\d+\b|\b[Pp][Hh][\w.\-_]*\b|\b[A-Z]{2,4}_\d+\b", ""),
    (r"(?iu)\b[ПФХКРС][НСХ][\-_]?\d+\b", ""),
)
GENERATED_TAIL = r"(?iu)(?:включен\s+и\s+подписан\s+на\s+марку|дата\s+(?:начала|окончания)\s+поиска|импр[её]ктор\b|\bл\.с\b|\b(?:на|и)\s*$)[\s\S]{0,40}$"


def clean_generated_unescaped(c: Column) -> Column:
    """Cleans generated text whose HTML entities are characters already."""
    c = drop_latin_short_lines(c)
    for pattern, by in GENERATED_NOISE:
        c = F.regexp_replace(c, f"(?U){pattern}", by)
    c = F.regexp_replace(dedup_repeated_tokens(c), f"{WS}+", " ")
    c = F.regexp_replace(c, f"(?U){GENERATED_TAIL}", "")
    c = F.regexp_replace(c, r"(?U)\s+([,.;:!?])", "$1")
    return strip(F.regexp_replace(c, r"(?U)^[;:,.\s]+", ""))
