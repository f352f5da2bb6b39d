"""Catalogue records: defaults, scrubbed names, searchable views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_in, blank_as_null, strip

# What local names are replaced with, headers and their synonyms, words and what people say for them.
DESK, OFFICE = "Bộ phận Một cửa của UBND Xã/Phường nơi cư trú", "UBND Xã/Phường nơi cư trú"
ANY_DESK = DESK + " (hoặc cơ quan có thẩm quyền theo quy định)"
LOCAL_NAMES = [
    (r"Trung tâm Phục vụ hành chính công phường Tăng Nhơn Phú,?\s*(Địa chỉ:?\s*)?(số\s*)?29\s*Lê Văn Việt.*?(TP\.?HCM|Thành phố Hồ Chí Minh)?", DESK),
    (r"Phòng Văn hóa - Xã hội thuộc Ủy ban nhân dân phường Tăng Nhơn Phú \(Địa chỉ: Số 29, đường Lê Văn Việt.*?\)\.?", OFFICE),
    (r"Trung tâm Phục vụ hành chính công phường Tăng Nhơn Phú", DESK),
    (r"TTPVHCC phường Tăng Nhơn Phú", DESK),
    (r"Tổ nội vụ - Phòng Văn hóa - xã hội phường Tăng Nhơn Phú", DESK),
    (r"tại phường Tăng Nhơn Phú", "tại " + OFFICE),
    (r"phường Tăng Nhơn Phú", OFFICE),
    (r"29 Lê Văn Việt", "trụ sở " + OFFICE),
    (r"Khám ở Bệnh viện Tâm thần\. Địa chỉ: 766 Võ Văn Kiệt.*?TP\.HCM\)?", "Khám tại cơ sở y tế có thẩm quyền theo quy định"),
]
SYNONYMS = {"ten_thu_tuc": "ten", "Tên thủ tục hành chính": "ten", "thanh_phan_ho_so": "ho_so", "Thành phần hồ sơ": "ho_so", "thoi_gian_text": "thoi_gian", "Thời gian giải quyết": "thoi_gian", "le_phi_text": "le_phi", "Lệ phí": "le_phi", "Địa điểm tiếp nhận hồ sơ trực tiếp (nếu có)": "dia_diem"}
SITUATIONS = [
    (["kết hôn", "hôn nhân"], "lấy vợ lấy chồng cưới xin kết hôn hôn thú làm đám cưới rước dâu đăng ký kết hôn lấy nhau hai vợ chồng kết hôn có yếu tố nước ngoài"),
    (["khai sinh"], "sinh con mới sinh đẻ con sinh em bé mới đẻ con mới sinh làm giấy khai sinh đăng ký khai sinh giấy chứng sinh"),
    (["khai tử", "tử tuất"], "người mất người chết người thân qua đời báo tử chứng tử mai táng giấy khai tử"),
    (["tình trạng hôn nhân", "độc thân"], "giấy độc thân xác nhận độc thân chưa có vợ chưa có chồng xin giấy độc thân"),
    (["căn cước", "cccd", "định danh"], "làm căn cước mất cccd làm lại căn cước đổi cccd làm thẻ căn cước cccd gắn chip vneid định danh điện tử"),
    (["hộ chiếu", "passport"], "làm hộ chiếu đổi hộ chiếu gia hạn hộ chiếu đi nước ngoài passport cấp hộ chiếu"),
    (["tạm trú", "thường trú", "cư trú"], "nhập hộ khẩu đăng ký tạm trú làm tạm trú chuyển khẩu ct07 chuyển chỗ ở nhập khẩu"),
    (["sổ đỏ", "sổ hồng", "đất đai", "quy hoạch"], "sang tên sổ đỏ làm sổ hồng mua đất bán nhà cấp sổ đỏ tranh chấp đất trích lục địa chính"),
    (["xây dựng", "sửa chữa nhà"], "xin phép xây nhà giấy phép xây dựng sửa nhà cấp phép xây dựng cơi nới nhà ở"),
    (["hộ kinh doanh", "buôn bán", "kinh doanh"], "mở quán mở tiệm bán hàng đăng ký kinh doanh hộ kinh doanh cá thể mở cửa hàng kinh doanh buôn bán"),
    (["chứng thực", "công chứng"], "sao y bản chính công chứng giấy tờ chứng thực chữ ký giấy ủy quyền công chứng hợp đồng"),
    (["mai táng", "hỏa táng"], "tiền mai táng hỗ trợ hỏa táng trợ cấp mai táng chi phí hỏa táng tang lễ"),
    (["bảo hiểm y tế", "hộ nghèo", "trợ cấp", "khuyết tật"], "làm thẻ bhyt miễn phí trợ cấp bảo trợ xã hội hỗ trợ người nghèo trợ cấp khuyết tật tiền trợ cấp"),
]
FIELDS = ["ten", "linh_vuc", "cap_thuc_hien", "co_quan", "ho_so", "thoi_gian", "le_phi", "dia_diem", "gio_cat_off", "can_cu_phap_ly", "nguon_url", "ma_thu_tuc"]
DEFAULTS = {"linh_vuc": "Hành chính công", "cap_thuc_hien": "Cơ quan có thẩm quyền"}


def scrub(c: Column) -> Column:
    """Local names out, in the patterns' order."""
    return strip(reduce(lambda out, p: F.regexp_replace(out, "(?iu)" + p[0], p[1]), LOCAL_NAMES, strip(F.coalesce(c, F.lit("")))))


def normalise(sheet: DataFrame) -> DataFrame:
    """Synonymous headers renamed, all fields scrubbed, absent ones defaulted, rows without a title dropped; row_id stays."""
    sheet = sheet.withColumnsRenamed({a: b for a, b in SYNONYMS.items() if a in sheet.columns})
    have = {c: scrub(F.col(c)) for c in FIELDS if c in sheet.columns}
    out = sheet.select("row_id", *[have.get(c, F.lit(DEFAULTS.get(c, ""))).alias(c) for c in FIELDS]).where("ten != ''")
    level = F.col("cap_thuc_hien") if "cap_thuc_hien" in have else F.lit("Cơ quan có thẩm quyền theo quy định")
    place = F.coalesce(blank_as_null(F.col("dia_diem")), F.lit(ANY_DESK))
    office = F.coalesce(blank_as_null(F.col("co_quan")), level)
    local = ["tăng nhơn phú", "lê văn việt"]
    return out.withColumns(
        {
            "dia_diem": F.when(any_in(F.lower(place), local), ANY_DESK).otherwise(place),
            "co_quan": F.when(any_in(F.lower(office), local), "UBND Cấp Xã/Phường nơi cư trú").otherwise(office),
            "ma_thu_tuc": F.col("ma_thu_tuc") if "ma_thu_tuc" in have else F.format_string("TT-%03d", F.col("row_id") + 1),
        }
    )


# Labels of the views.
NAME, SITUATION_LABEL, LAW_LABEL, DOSSIER_LABEL = "Thủ tục: ", ". Tình huống thực tế đời thường của người dân: ", ". Căn cứ pháp lý: ", ". Thành phần hồ sơ cần chuẩn bị: "
TITLE_LABELS = [("Lĩnh vực: ", "linh_vuc"), ("Cấp thực hiện: ", "cap_thuc_hien")]
SUMMARY_LABELS = [("Thời gian giải quyết: ", "thoi_gian"), ("Lệ phí: ", "le_phi"), ("Địa điểm tiếp nhận: ", "dia_diem"), ("Giờ tiếp nhận / Cắt hồ sơ: ", "gio_cat_off")]


def _labelled(*parts: tuple[str, str]) -> Column:
    return F.concat_ws(". ", *[F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c))) for label, c in parts])


def situational() -> Column:
    name = F.lower(F.concat_ws(" ", "ten", "linh_vuc"))
    said = F.concat_ws(" ", *[F.when(any_in(name, words), F.lit(text)) for words, text in SITUATIONS])
    return strip(F.concat(F.lit(NAME), F.col("ten"), F.lit(SITUATION_LABEL), said))


def view_columns() -> dict[str, Column]:
    title = F.concat(F.lit(NAME), F.col("ten"))
    return {
        "title": F.concat_ws(". ", title, blank_as_null(_labelled(*TITLE_LABELS))),
        "summary": F.concat_ws(". ", title, blank_as_null(_labelled(*SUMMARY_LABELS))),
        "docs": F.when(F.col("ho_so") == "", F.concat(title, F.lit(LAW_LABEL), F.col("can_cu_phap_ly"))).otherwise(F.concat(title, F.lit(DOSSIER_LABEL), F.col("ho_so"))),
        "situational": situational(),
    }


def build_views(catalogue: DataFrame) -> DataFrame:
    """Four rows for each record: id, row_id, view, document. Narrow: no shuffle."""
    views = F.explode(F.array(*[F.struct(F.lit(name).alias("view"), c.alias("document")) for name, c in view_columns().items()])).alias("v")
    return catalogue.select("row_id", views).select(F.concat_ws("::", F.col("row_id").cast("string"), "v.view").alias("id"), "row_id", "v.view", "v.document").where(strip(F.col("document")) != "")


def lexical_text() -> Column:
    """What BM25 reads: the title twice, the situations, and the other fields that are there."""
    fields = ["linh_vuc", "cap_thuc_hien", "co_quan", "ho_so", "thoi_gian", "le_phi", "dia_diem", "can_cu_phap_ly", "ma_thu_tuc"]
    return F.concat_ws(" ", "ten", "ten", situational(), *[blank_as_null(F.col(c)) for c in fields])
