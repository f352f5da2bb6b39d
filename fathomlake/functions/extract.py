"""Fields out of crawled text and HTML. Patterns are Java's; (?iu) because (?i) alone leaves accented letters out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_tree import page_items
from .text import any_in, blank_as_null, let, strip

# Words of the levels, of same-day service, of free service, and what is no fee.
LEVELS = [("Trung ương", ["trung ương", "tại cục", "bộ công an"]), ("Tỉnh", ["cấp tỉnh", "công an tỉnh", "công an thành phố"]), ("Huyện", ["cấp huyện", "công an huyện", "công an quận"]), ("Xã", ["cấp xã", "công an xã", "công an phường", "thị trấn"])]
SAME_DAY = ["trong ngày", "tiếp nhận ngay", "giải quyết ngay", "ngay khi"]
FREE = ["miễn phí", "không thu"]
JUNK_FEE = r"(?iu)^\s*(trực tiếp|trực tuyến|dịch vụ bưu chính)\s*$|^\s*trực tiếp\s+trực tuyến\s*$|\d+\s*ngày làm việc|giờ hành chính|thời gian tiếp nhận|^\s*không\s*$|^\s*không có\s*$|^\s*$"
DURATION_TAIL, DURATION = r"(?iu)[,:\-\s]+cụ thể(\s+như\s+sau)?.*$", r"(?iu)(\d+)\s*(ngày làm việc|ngày|tháng|giờ)"
TODAY_PATTERN, CHECKED = r"(?iu)(?:ngay\s+)?trong ngày làm việc|(?:giải quyết|tiếp nhận)\s+ngay|ngay\s+khi", r"(?iu)trong thời hạn\s+(\d+)\s*ngày làm việc"
NO_DURATION, CHECKS, CELL_HEADS = ["giờ hành chính", "thời gian tiếp nhận"], "xác minh", ["tên giấy tờ", "mẫu đơn, tờ khai", "số lượng"]
DOSSIER_HEADS = ["thành phần hồ sơ", "+ thành phần hồ sơ", "số lượng hồ sơ", "+ số lượng hồ sơ", "tên giấy tờ", "mẫu đơn", "số lượng", "bản chính:", "bản sao:"]
NO_TIME, TODAY = "Theo quy định hiện hành", "Giải quyết ngay trong ngày làm việc"
NO_CHARGE, FREE_OF_CHARGE, NOT_SET, NOT_SET_YET = ["không thu lệ phí", "miễn phí"], "Miễn phí (Không thu lệ phí)", ["chưa quy định.", "chưa quy định"], "Chưa quy định (hoặc theo quy định Bộ Tài chính)"
NO_FEE = "Miễn phí"
NO_LAW, NO_DOSSIER = "Theo quy định pháp luật chuyên ngành hiện hành", "Theo quy định hướng dẫn tại cơ quan tiếp nhận"


def admin_level(title: Column, office: Column) -> Column:
    s = F.lower(F.concat_ws(" ", title, office))
    found = F.concat_ws(" / ", *[F.when(any_in(s, words), F.lit(level)) for level, words in LEVELS])
    return F.when(found == "", "Cấp Tỉnh").otherwise(F.concat(F.lit("Cấp "), found))


def duration_days(c: Column) -> Column:
    """1 for same-day service, else the last whole number, whatever its unit; null without one."""
    number = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?U)\b(\d+)\b")), F.lit(-1))
    return F.when(any_in(F.lower(c), SAME_DAY), 1).otherwise(number.try_cast("int"))


def fee_vnd(c: Column) -> Column:
    """0 where free, else the first amount with dotted thousands."""
    amount = F.regexp_extract(c, r"(\d{1,3}(?:\.\d{3})+)", 1)
    return F.when(any_in(F.lower(c), FREE), 0).when(amount != "", F.replace(amount, F.lit("."), F.lit("")).try_cast("int"))


def duration_info(c: Column) -> Column:
    """struct(n, unit) of a line, null where it has none; n = 0 stands for the same day."""
    return let(F.regexp_replace(strip(F.regexp_replace(c, DURATION_TAIL, "")), r"[:,;.\- \t\n]+$", ""), _duration)


def _duration(t: Column) -> Column:
    low, unit, days = F.lower(t), F.lower(F.regexp_extract(t, DURATION, 2)), F.regexp_extract(t, CHECKED, 1)

    def pair(n: Column, unit: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), unit.alias("unit"))

    none = F.lit(None).cast("struct<n:int,unit:string>")
    return (
        F.when(any_in(low, NO_DURATION), none)
        .when(t.rlike(TODAY_PATTERN), pair(F.lit(0), F.lit("trong ngày làm việc")))
        .when(F.contains(low, F.lit(CHECKS)), F.when(days != "", pair(days.try_cast("int"), F.lit("ngày làm việc"))))
        .when(unit != "", pair(F.regexp_extract(t, DURATION, 1).try_cast("int"), unit))
    )


def format_durations(found: Column) -> Column:
    """One text for an array of struct(n, unit): units in order of first appearance, each with its least and greatest n."""
    return let(found, _durations)


def _durations(found: Column) -> Column:
    units = F.array_distinct(F.transform(found, lambda x: x["unit"]))

    def of(unit: Column) -> Column:
        n = F.transform(F.filter(found, lambda x: (x["unit"] == unit) & (x["n"] != 0)), lambda x: x["n"])
        low, high = F.format_string("%02d", F.array_min(n)), F.format_string("%02d", F.array_max(n))
        return F.when(F.size(n) == 0, None).when(low == high, F.concat(low, F.lit(" "), unit)).otherwise(F.concat(F.lit("Từ "), low, F.lit(" - "), high, F.lit(" "), unit))

    text = F.array_join(F.array_compact(F.transform(units, of)), "; ")
    return F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, NO_TIME).when(F.exists(found, lambda x: x["n"] == 0), TODAY).otherwise(text)


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")


def once(items: Column) -> Column:
    """Without repeats that differ only in case; the first of each stays, in order."""
    def firsts(both: Column) -> Column:
        return F.filter(both["items"], lambda x, i: F.array_position(both["low"], F.lower(x)) == i + 1)

    return let(items, lambda x: let(F.struct(x.alias("items"), F.transform(x, F.lower).alias("low")), firsts))


def resolution_time(html: Column) -> Column:
    """Durations of the text in <i> elements, or else of the lines."""
    def found(parts: Column) -> Column:
        return F.filter(F.transform(parts, duration_info), lambda x: x.isNotNull())

    italic = found(F.regexp_extract_all(html, F.lit(r"(?is)<i>([^<]*)</i>")))
    return format_durations(let(italic, lambda x: F.when(F.size(x) > 0, x).otherwise(found(lines(plain_text(html))))))


def plain_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)</?(p|div|br|li|ul|tr|td|h1|h2|h3|article|nav|footer|title)\b[^>]*>", "\n"), r"<[^>]*>", "")


def elements(html: Column, names: str) -> Column:
    """Texts of the elements of some names (alternatives), tags inside taken out, spaces single."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<({names})\b[^>]*>(.*?)(?=</({names})>|<({names})\b|$)"), F.lit(2))
    return F.transform(found, lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")))


def bullets_off(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"^[+\-*•\s]+", ""))


def legal_basis(html: Column) -> Column:
    """Paragraphs and list items without bullets and numbers of acts, over four letters, once each."""
    items = F.transform(elements(html, "li|p"), lambda x: strip(F.regexp_replace(bullets_off(x), r"(?iu)\s*Số:\s*[\p{L}\p{N}_/\-]+", "")))
    raw = strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))
    return let(once(F.filter(items, lambda x: F.length(x) > 4)), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "; ")).when(F.length(raw) > 5, raw).otherwise(NO_LAW))


def dossier(html: Column) -> Column:
    """First cells of table rows, or else the lines, as one list."""
    cells = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>\s*<td\b[^>]*>(.*?)</td>")), lambda x: F.regexp_replace(bullets_off(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " ")), r"[;.,]+$", ""))
    cells = F.filter(F.transform(cells, strip), lambda x: (x != "") & ~F.lower(x).isin(CELL_HEADS))
    rows = F.filter(lines(plain_text(html)), lambda x: ~_starts(x, DOSSIER_HEADS))
    rows = F.filter(F.transform(rows, item), lambda x: F.length(x) > 8)
    items = let(cells, lambda x: F.when(F.size(x) > 0, x).otherwise(rows))
    kept = once(F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: F.length(x) > 5))
    return let(kept, lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise(NO_DOSSIER))


def _starts(c: Column, heads: list[str]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.lower(c).startswith(F.lit(h))
    return out


def item(c: Column) -> Column:
    """A line without its number or bullet, and without marks at its end."""
    return strip(F.regexp_replace(bullets_off(F.regexp_replace(c, r"^([a-zA-ZđĐ]\)|\d+[.)]|[+\-*•])\s*", "")), r"[;.,]+$", ""))


def comma_list(c: Column) -> Column:
    """A dossier of several lines as one list between commas."""
    kept = F.filter(F.transform(lines(c), item), lambda x: (x != "") & ~_starts(x, DOSSIER_HEADS[:3]))
    return let(kept, lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise(strip(F.coalesce(c, F.lit("")))))


def clean_fee(fee: Column, charge: Column) -> Column:
    """Two raw fields as one text: junk lines out, once each, the usual words for none."""
    def valid(c: Column) -> Column:
        return F.filter(F.transform(lines(c), lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: ~x.rlike(JUNK_FEE))

    raw = F.lower(F.concat_ws(" ", fee, charge))

    def text(both: Column) -> Column:
        pieces = F.flatten(F.transform(both, lambda x: F.split(x, ";")))
        joined = F.array_join(once(F.filter(F.transform(pieces, lambda x: F.regexp_replace(strip(x), r"[;,]+$", "")), lambda x: x != "")), "; ")
        free = any_in(raw, NO_CHARGE) & (F.size(both) == 0)
        return F.when(free, FREE_OF_CHARGE).otherwise(let(joined, lambda x: F.when(x == "", NO_FEE).when(F.lower(x).isin(NOT_SET), NOT_SET_YET).otherwise(x)))

    return let(F.concat(valid(fee), valid(charge)), text)


# What stands for a field that a page does not have.
NO_FIELD, NO_OFFICE, NO_CODE = "Quản lý hành chính", "Bộ phận Một cửa - Cơ quan Công an / UBND có thẩm quyền", "CHUA_CAP_MA"
CODE_TITLES, DOSSIER_TITLES, TIME_TITLES, LAW_TITLES = ["mã thủ tục", "mã tthc"], ["thành phần", "hồ sơ"], ["thời hạn", "thời gian"], ["pháp lý", "căn cứ"]
STAY, BY_RULE = "lưu trú", "theo quy định"


def _field(items: Column, title: str) -> Column:
    """The text of the item of that very title; blank without one."""
    return F.coalesce(F.try_element_at(F.filter(items, lambda x: x["title"] == title), F.lit(-1))["text"], F.lit(""))


def _first(items: Column, words: list[str]) -> Column:
    """The first item with one of the words in its title, or null."""
    return F.try_element_at(F.filter(items, lambda x: any_in(x["low"], words)), F.lit(1))


def page_record(pages: DataFrame, day: Column) -> DataFrame:
    """The 13 columns of a crawled record from detail pages (title, url, html), and page_id."""
    rows = pages.select("page_id", "title", "url", page_items(F.col("html")).alias("items"))
    items = F.col("items")
    code = F.coalesce(*[blank_as_null(strip(_first(items, [w])["text"])) for w in CODE_TITLES], F.when(url_parameter(F.col("url"), "matt") != "", F.concat(F.lit("BCA-"), url_parameter(F.col("url"), "matt"))), F.lit(NO_CODE))
    rows = rows.select(
        "page_id", "url", "title", code.alias("ma_thu_tuc"), F.coalesce(blank_as_null(_field(items, "Lĩnh vực")), F.lit(NO_FIELD)).alias("linh_vuc"), F.coalesce(blank_as_null(_field(items, "Cơ quan thực hiện")), F.lit(NO_OFFICE)).alias("co_quan"),
        clean_fee(_field(items, "Phí"), _field(items, "Lệ Phí")).alias("le_phi_text"), _first(items, DOSSIER_TITLES)["inner"].alias("docs"), _field(items, "Thành phần hồ sơ").alias("docs_text"), _first(items, TIME_TITLES)["inner"].alias("time"), _first(items, LAW_TITLES)["inner"].alias("law"),
    )
    docs = F.when(F.col("docs").isNotNull(), dossier(F.col("docs"))).otherwise(F.coalesce(blank_as_null(comma_list(F.col("docs_text"))), F.lit(NO_DOSSIER)))
    time = F.when(F.col("time").isNotNull(), resolution_time(F.col("time"))).otherwise(NO_TIME)
    rows = rows.withColumns({"thanh_phan_ho_so": docs, "thoi_gian_text": time, "can_cu_phap_ly": F.when(F.col("law").isNotNull(), legal_basis(F.col("law"))).otherwise(NO_LAW)})
    stay = F.contains(F.lower("title"), F.lit(STAY)) & (F.contains(F.lower("thoi_gian_text"), F.lit(BY_RULE)) | (F.col("thoi_gian_text") == ""))
    rows = rows.withColumn("thoi_gian_text", F.when(stay, TODAY).otherwise(F.col("thoi_gian_text")))
    return rows.select(
        "page_id", "ma_thu_tuc", F.col("title").alias("ten_thu_tuc"), "linh_vuc", admin_level(F.col("title"), F.col("co_quan")).alias("cap_thuc_hien"), "co_quan", "thanh_phan_ho_so", "thoi_gian_text", duration_days(F.col("thoi_gian_text")).alias("thoi_gian_ngay"),
        "le_phi_text", fee_vnd(F.col("le_phi_text")).alias("le_phi_vnd"), "can_cu_phap_ly", F.col("url").alias("nguon_url"), F.date_format(day, "yyyy-MM-dd").alias("ngay_crawl"),
    )


def url_parameter(url: Column, key: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)), F.lit(""))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))
