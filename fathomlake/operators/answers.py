"""Answers as text: a record's card, a list of options, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import is_situational
from ..functions.text import any_in, blank_as_null, outside_parentheses
from .catalogue import ANY_DESK, scrub

# Openings by words of the question (%s: title and level), labels and defaults of a card.
INTROS = [
    (["đẻ", "sinh con", "sinh em bé", "khai sinh", "mới sinh"], "Chào bạn! Chúc mừng gia đình có thêm thành viên mới. Thủ tục bạn cần thực hiện cho cháu là **%s** (%s):\n\n"),
    (["cưới", "lấy vợ", "lấy chồng", "kết hôn", "hôn nhân", "độc thân"], "Chào bạn! Đối với việc đăng ký kết hôn và xây dựng gia đình, thủ tục bạn cần thực hiện là **%s** (%s):\n\n"),
    (["mất", "chết", "qua đời", "khai tử", "tử tuất"], "Chào bạn! Với sự việc này, thủ tục gia đình cần thực hiện là **%s** (%s):\n\n"),
    (["cccd", "căn cước", "định danh"], "Chào bạn! Về thủ tục thẻ Căn cước công dân, thông tin hướng dẫn chuẩn xác như sau:\n\n"),
    (["học bổng", "miễn giảm", "học phí"], "Chào bạn! Về chế độ chính sách học tập, thủ tục cần nộp hồ sơ là **%s** (%s):\n\n"),
]
SITUATION_INTRO = "Chào bạn! Đối với tình huống của bạn, thủ tục hành chính cần thực hiện là **%s** (%s):\n\n"
OPTIONS_HEAD = "Hệ thống nhận thấy yêu cầu của bạn có thể thuộc về các thủ tục hành chính dưới đây. Vui lòng bấm chọn hoặc nêu rõ thủ tục bạn muốn thực hiện:\n"
LABELS = ["### ", "- **Mã thủ tục**: `", "- **Lĩnh vực**: ", "- **Cấp thực hiện**: ", "- **Thời gian giải quyết**: **", "- **Lệ phí**: **", "- **Nơi tiếp nhận hồ sơ**: ", "- **Quy định tiếp nhận / Giờ cắt hồ sơ**: "]
DEFAULTS = {"ma_thu_tuc": "Đang cập nhật", "linh_vuc": "Hành chính công", "cap_thuc_hien": "Cơ quan có thẩm quyền theo quy định", "thoi_gian": "Theo quy định", "le_phi": "Miễn phí"}
DOCS_HEAD, NO_DOCS = "\n**Thành phần hồ sơ cần chuẩn bị:**", "  * Hồ sơ theo mẫu quy định tại cơ quan tiếp nhận."
LAW, LINK = "\n*Căn cứ pháp lý: ", "\n[Tra cứu chi tiết trên Cổng Dịch vụ công]("
OPTIONS_TAIL = "\n*Nếu nhu cầu của bạn khác các lựa chọn trên, hãy miêu tả chi tiết hơn nhé.*"


# Tiers, also by other names, and what a reader sees for them; another tier T is "Tầng T".
TIER_LABELS = {
    "A": "Tầng A — Dữ liệu chuẩn xác CSDL", "TIER_A": "Tầng A — Dữ liệu chuẩn xác CSDL", "B": "Tầng B — Cần làm rõ nhu cầu thủ tục", "TIER_B": "Tầng B — Cần làm rõ nhu cầu thủ tục", "TRAFFIC": "Ngoài danh mục", "NGOAI": "Ngoài danh mục",
    "C": "Tầng C — Tra cứu Cổng DVC (.gov.vn)", "TIER_C": "Tầng C — Tra cứu Cổng DVC (.gov.vn)", "SMALLTALK": "Xã giao thân mật", "XAGIAO": "Xã giao thân mật",
}
# The texts of prompts; {context} and {question} stand for those.
TRAFFIC_SYSTEM = """Bạn là Trợ lý tư vấn pháp luật giao thông đường bộ Việt Nam.
QUY TẮC BẮT BUỘC:
1. CẤM nhại lại câu hỏi của công dân. Đi thẳng vào câu trả lời.
2. Nêu chính xác mức phạt theo Nghị định 100/2019/NĐ-CP và Nghị định 123/2021/NĐ-CP đúng với lỗi/hành vi trong câu hỏi.
3. TUYỆT ĐỐI KHÔNG tự bịa hoặc suy diễn sang các lỗi không liên quan nếu người dùng không hỏi.
4. Lời văn ngắn gọn, khách quan, súc tích."""
WEB_PROMPT = """Bạn là Trợ lý Dịch vụ công & Thủ tục Hành chính Việt Nam.
Người dùng đang hỏi một câu hỏi (có thể là thủ tục hành chính hoặc vấn đề dân sinh, hóa đơn tiện ích ngoài lề).
THÔNG TIN TRA CỨU ĐƯỢC TỪ INTERNET:
---------------------
{context}
---------------------

CÂU HỎI CỦA CÔNG DÂN: "{question}"

QUY TẮC TRẢ LỜI BẮT BUỘC:
1. Nếu câu hỏi về thủ tục hành chính: Tóm tắt ngắn gọn các bước, hồ sơ và nơi tiếp nhận.
2. NẾU CÂU HỎI NGOÀI LỀ (như hóa đơn điện nước, cước viễn thông, sinh hoạt dân sự):
   - Hãy trả lời tóm lược sơ bộ các ý chính để giúp người dân nắm được tình hình cơ bản.
   - Nhắc nhở khéo léo rằng bạn là Trợ lý chuyên về Thủ tục Hành chính công (UBND), không quản lý các dịch vụ ngoài lề này nên không thể tư vấn chi tiết, và khuyên người dân liên hệ trực tiếp đơn vị cung cấp dịch vụ hoặc cơ quan có thẩm quyền để được hỗ trợ cụ thể.
   - TUYỆT ĐỐI KHÔNG ép câu hỏi sang các thủ tục hành chính không liên quan (như hỏa táng, thị thực, khai sinh...).
3. Lời văn ngắn gọn, khách quan, súc tích, khiêm tốn."""
NO_CONTEXT = "Không tìm thấy dữ liệu trực tuyến."


def _or(c: str) -> Column:
    return F.coalesce(blank_as_null(F.col(c)), F.lit(DEFAULTS[c]))


def _intro(question: Column) -> Column:
    def text(t: str) -> Column:
        return F.format_string(t, F.col("ten"), F.col("cap_thuc_hien")) if "%s" in t else F.lit(t)

    out, q = F, F.lower(question)
    for words, t in INTROS:
        out = out.when(any_in(q, words), text(t))
    return F.when(F.coalesce(question, F.lit("")) == "", "").otherwise(out.when(is_situational(question), text(SITUATION_INTRO)).otherwise(""))


def card(question: Column) -> Column:
    """A catalogue record as an answer."""
    docs = outside_parentheses(scrub(F.col("ho_so")))
    bullets = F.when(scrub(F.col("ho_so")) == "", F.array(F.lit(NO_DOCS))).otherwise(F.transform(F.when(F.size(docs) > 1, docs).otherwise(F.array(scrub(F.col("ho_so")))), lambda d: F.concat(F.lit("  * "), d)))
    place = F.coalesce(blank_as_null(scrub(F.col("dia_diem"))), F.lit(ANY_DESK))
    values = [F.col("ten"), _or("ma_thu_tuc"), _or("linh_vuc"), _or("cap_thuc_hien"), _or("thoi_gian"), _or("le_phi"), place, blank_as_null(F.col("gio_cat_off"))]
    # A label that opens a mark closes it after the value.
    head = [F.concat(F.lit(label), value, F.lit("`" if label.endswith("`") else "**" if label.endswith(" **") else "")) for label, value in zip(LABELS, values, strict=True)]
    tail = [F.concat(F.lit(LAW), blank_as_null(F.col("can_cu_phap_ly")), F.lit("*")), F.concat(F.lit(LINK), blank_as_null(F.col("nguon_url")), F.lit(")"))]
    return F.concat(_intro(question), F.array_join(F.array_compact(F.concat(F.array(*head, F.lit(DOCS_HEAD)), bullets, F.array(*tail))), "\n"))


def tier_label(tier: Column) -> Column:
    """What a reader sees for a tier, in any case of letters; nothing for a null or blank one."""
    known = F.create_map(*[F.lit(x) for pair in TIER_LABELS.items() for x in pair])
    return F.when(F.coalesce(tier, F.lit("")) == "", "").otherwise(F.coalesce(F.try_element_at(known, F.upper(tier)), F.concat(F.lit("Tầng "), tier)))


def traffic_messages(question: Column) -> Column:
    """The two messages of a traffic question for a language model."""
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", F.lit(TRAFFIC_SYSTEM)), ("user", question))])


def web_context(hits: DataFrame, k: int = 4) -> DataFrame:
    """qid, context: the first k hits of a question (pos, title, body) with a body, as a list."""
    some = hits.where((F.col("pos") < k) & (F.coalesce(F.trim("body"), F.lit("")) != ""))
    line = F.struct("pos", F.concat(F.lit("- **"), F.col("title"), F.lit("**: "), F.trim("body")).alias("t"))
    return some.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("context"))


def web_prompt(question: Column, context: Column) -> Column:
    """The prompt of a question that only the web answers."""
    head, rest = WEB_PROMPT.split("{context}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit(middle), question, F.lit(tail))


def options(candidates: DataFrame, k: int = 3) -> DataFrame:
    """qid, answer: a question's best k candidates (final_rank, ten, cap_thuc_hien, le_phi) as a numbered list."""
    level = F.when(F.coalesce("cap_thuc_hien", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), F.col("cap_thuc_hien"), F.lit(")")))
    fee = F.when(F.coalesce("le_phi", F.lit("")) == "", "").otherwise(F.concat(F.lit(" | Phí: "), F.col("le_phi")))
    line = F.concat(F.lit("**"), F.col("ten"), F.lit("**"), level, fee).alias("line")
    listed = candidates.where(F.col("final_rank") < k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("final_rank", line))).alias("l"))
    numbered = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    return listed.select("qid", F.array_join(F.concat(F.array(F.lit(OPTIONS_HEAD)), numbered, F.array(F.lit(OPTIONS_TAIL))), "\n").alias("answer"))


def answered(model: Column, fallback: str) -> Column:
    """A language model's answer where there is one, else the fallback; local names scrubbed."""
    return scrub(F.coalesce(blank_as_null(model), F.lit(fallback)))
