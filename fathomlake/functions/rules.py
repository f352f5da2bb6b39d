"""Ordered rules over questions: small talk, special situations, traffic, routing.

The keywords of all rules are looked for together, in one pass over a text (see automaton.py); what a rule needs of them is
then a test of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import first_group, groups_in
from .text import strip

# Fixed values of the rules: keywords in the order in which they are looked for.
WHO = ["bạn là ai", "ban la ai", "bạn tên gì", "ban ten gi", "ai tạo ra bạn", "ai tao ra ban"]
THANKS = ["cảm ơn", "cam on", "thanks", "thank you", "cám ơn", "thank", "thx"]
BYE = ["tạm biệt", "tam biet", "bye", "goodbye", "hẹn gặp lại"]
GREETINGS = ["xin chào", "xin chao", "chào bạn", "chao ban", "chào bot", "chao bot", "hello", "helo", "hi", "alo", "hế lô", "hê lô", "heyy", "hey", "chào", "chao", "chào buổi sáng", "chào buổi chiều", "chào buổi tối", "ê", "êy", "alo bot"]
OPENINGS = ["chào", "chao", "hello", "helo", "hi", "alo", "hey"]
SITUATION = ["tôi", "em", "mình", "con", "cháu", "vợ", "chồng", "sinh", "đẻ", "chết", "mất", "cưới", "lấy", "mua", "bán", "xây", "sửa", "mở", "làm gì", "cần gì", "thế nào", "ở đâu", "bao lâu", "bao nhiêu", "được không", "hết bao nhiêu", "như thế nào", "phải làm", "giúp tôi", "cho hỏi", "tuần sau", "hôm nay", "mới", "cần gt j", "cần giấy tờ gì", "hồ sơ gì", "thủ tục gì"]
TRAFFIC = ["xe", "giao thông", "giao thong", "đèn đỏ", "den do", "đèn vàng", "den vang", "mũ bảo hiểm", "mu bao hiem", "nón bảo hiểm", "non bao hiem", "nồng độ cồn", "nong do con", "bằng lái", "bang lai", "gplx", "tốc độ", "toc do", "lấn làn", "lan duong", "làn đường", "biển số", "bien so", "đăng kiểm", "dang kiem", "cavet", "ca vet", "tước bằng", "tuoc bang", "dừng đỗ", "dung do", "ngược chiều", "nguoc chieu", "uống rượu", "uong ruou", "uống bia", "uong bia", "thổi cồn", "thoi con", "bắn tốc độ", "ban toc do", "bảo hiểm xe", "bao hiem xe"]
#: (rule, keywords); the first that matches answers.
TRAFFIC_RULES = [
    ("lost_plate", ["mất biển số", "mat bien so", "rơi biển số", "mất biển", "mat bien", "cấp lại biển số", "xin lại biển số"]),
    ("no_plate", ["không biển số", "ko bien so", "không có biển", "ko co bien", "không mang biển", "ko mang bien", "lái xe ko biển", "chạy xe không biển", "chay xe khong bien"]),
    ("helmet", ["mũ bảo hiểm", "mu bao hiem", "nón bảo hiểm", "non bao hiem", "không đội mũ", "ko doi mu"]),
    ("alcohol", ["nồng độ cồn", "nong do con", "uống rượu", "uong ruou", "uống bia", "uong bia", "thổi cồn", "thoi con"]),
    ("red_light", ["vượt đèn đỏ", "vuot den do", "đèn đỏ", "den do", "vượt đèn vàng", "vuot den vang"]),
    ("licence", ["bằng lái", "bang lai", "giấy phép lái xe", "gplx", "không có bằng", "khong co bang", "quên bằng", "quen bang"]),
    ("insurance", ["bảo hiểm xe máy", "bao hiem xe may", "bảo hiểm bắt buộc", "bảo hiểm tnds"]),
]
#: (rule, tier, groups of keywords); each group must match.
SPECIAL_RULES = [
    ("has_id_card", "A", [["có cccd rồi", "co cccd roi", "làm xong cccd rồi", "đã có cccd", "da co cccd", "làm cccd rồi"], ["làm gì", "tiếp theo", "cần gì"]]),
    ("tree_cutting", "NGOAI", [["chặt cây", "chat cay", "đốn cây", "don cay", "tỉa cây", "tia cay", "cắt cây", "cat cay"], ["vườn", "vuon", "nhà", "nha", "đất", "dat", "rào", "rao"]]),
    ("noise", "NGOAI", [["karaoke", "hát hò", "tiếng ồn", "tieng on", "ồn ào", "on ao"], ["phạt", "đêm", "22h", "hàng xóm", "khuya"]]),
    ("dog", "NGOAI", [["chó thả rông", "cho tha rong", "chó cắn", "không rọ mõm", "ko ro mom"]]),
    ("utilities", "NGOAI", [["tiền điện", "tien dien", "đóng điện", "dong dien", "tiền nước", "tien nuoc", "tiền mạng", "tien mang"]]),
]
#: The utility that a question is about: by a word in it, the first that is there.
UTILITIES = [("điện", "tiền điện"), ("nước", "tiền nước")]
OTHER_UTILITY = "cước viễn thông/mạng"


#: Groups of keywords looked for in a question without punctuation, and in a question as it is.
TALK = tuple(map(tuple, (WHO, THANKS, BYE)))
SITUATIONAL, IS_TRAFFIC, FIRST_SPECIAL = 0, 1, 2
GATES = tuple(map(tuple, (SITUATION, TRAFFIC, *[g for _, _, groups in SPECIAL_RULES for g in groups])))


def gates(c: Column) -> Column:
    """Which of GATES hold. The same column wherever it is asked for, so that Spark finds it once for a text."""
    return groups_in(F.lower(c), GATES)


def small_talk(c: Column) -> Column:
    """hello, who, thanks, bye, or null. A text of punctuation alone is no small talk."""
    s = strip(F.lower(F.coalesce(c, F.lit(""))))
    clean = strip(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", ""))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    greeting = clean.isin(GREETINGS) | ((F.size(words) <= 3) & F.try_element_at(words, F.lit(1)).isin(OPENINGS))
    said = first_group(clean, TALK)
    return F.when(F.length(s) <= 1, "hello").when(said == 0, "who").when(said == 1, "thanks").when(said == 2, "bye").when(greeting, "hello")


def is_situational(c: Column) -> Column:
    return F.array_contains(gates(c), SITUATIONAL) | (F.size(F.filter(F.split(strip(F.lower(c)), r"\s+"), lambda w: w != "")) >= 4)


def _special(c: Column, what: int) -> Column:
    held, out, at = gates(c), F, FIRST_SPECIAL
    for rule in SPECIAL_RULES:
        need, at = range(at, at + len(rule[2])), at + len(rule[2])
        out = out.when(F.size(F.array_intersect(held, F.array(*map(F.lit, need)))) == len(need), F.lit(rule[what]))
    return out


def special(c: Column) -> Column:
    """The first special rule whose groups of keywords all match, or null."""
    return _special(c, 0)


def special_tier(c: Column) -> Column:
    """The tier of the first special rule that matches, or null."""
    return _special(c, 1)


def utility(c: Column) -> Column:
    q, out = F.lower(c), F
    for word, name in UTILITIES:
        out = out.when(F.contains(q, F.lit(word)), F.lit(name))
    return out.otherwise(F.lit(OTHER_UTILITY))


def is_traffic(c: Column) -> Column:
    """A plain substring test: "xe" is also in "xem"."""
    return F.array_contains(gates(c), IS_TRAFFIC)


def rule_table(spark) -> DataFrame:
    """rule, priority, keywords: as many rows as there are rules."""
    return spark.createDataFrame([(r, i, k) for i, (r, k) in enumerate(TRAFFIC_RULES)], "rule string, priority int, keywords array<string>")


def first_rule(questions: DataFrame, rules: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """qid and the matching rule of least priority (of equal ones the first by name); no row where none matches. The rules
    are a table for people to write: up to max_rules of them make one automaton, more are joined."""
    some = rules.select("rule", "priority", "keywords").limit(max_rules + 1).collect()
    if len(some) > max_rules:
        found = questions.join(rules, F.expr("exists(keywords, k -> contains(lower(text), k))"))
        return found.groupBy("qid").agg(F.min_by("rule", F.struct("priority", "rule")).alias("rule"))
    some = sorted(some, key=lambda r: (r.priority, r.rule))
    if not some:
        return questions.select("qid", F.lit(None).cast("string").alias("rule")).limit(0)
    first = first_group(F.lower("text"), tuple(tuple(r.keywords) for r in some))
    found = questions.select("qid", F.try_element_at(F.array(*[F.lit(r.rule) for r in some]), first + 1).alias("rule"), first.alias("place"))
    return found.where("place IS NOT NULL").groupBy("qid").agg(F.min_by("rule", "place").alias("rule"))


def route(c: Column) -> Column:
    """The first gate that takes a question: SMALLTALK, a special rule's tier, TRAFFIC, or RETRIEVE."""
    return F.when(small_talk(c).isNotNull(), "SMALLTALK").otherwise(F.coalesce(special_tier(c), F.when(is_traffic(c), "TRAFFIC"), F.lit("RETRIEVE")))
