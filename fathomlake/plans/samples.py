"""Small inline tables for rules that the test tables have no texts for."""

from __future__ import annotations

QUESTIONS = [
    "Xin chào", "hi", "", "a", "??", "Bạn là ai vậy?", "cảm ơn bạn nhiều", "Tạm biệt nhé!", "chào buổi sáng", "Tôi mất biển số xe thì làm sao", "xe không biển số bị phạt bao nhiêu",
    "Không đội mũ bảo hiểm phạt thế nào", "uong ruou lai xe phat bao nhieu", "VƯỢT ĐÈN ĐỎ phạt tiền", "quên bằng lái xe", "bảo hiểm xe máy bắt buộc không", "xem lịch làm việc", "Tôi đã có CCCD rồi cần gì nữa",
    "chặt cây trong vườn nhà có bị phạt không", "hàng xóm karaoke ban đêm", "chó thả rông cắn người", "không đóng tiền điện", "không đóng tiền nước bị cắt", "đóng tien mang ở đâu",
    "Đăng ký KẾT HÔN, lệ phí?", "dang ky khai sinh can giay to gi", "vợ tôi mới sinh con làm giấy gì", "thủ tục khai tử", "đổi hộ chiếu", "alo bot ơi giúp với",
]
LINES = [
    "Từ 03 - 05 ngày làm việc", "Giải quyết ngay trong ngày làm việc", "Theo quy định hiện hành", "Miễn phí", "50.000 đồng", "1.000.000đ", "50000đ", "Không thu phí", "03 Ngày làm việc", "Không quá 02 ngày làm việc",
    "Trong giờ hành chính thứ 2", "Xác minh trong thời hạn 15 ngày làm việc", "xác minh mất giấy tờ", "2 tháng", "24 giờ, cụ thể như sau: x", "Công an xã", "Công an tỉnh và cấp huyện", "Bộ Công an; cấp xã", "Sở Tư pháp", "12,5 ngày",
]
#: row_id, ten, linh_vuc, cap_thuc_hien, co_quan, ho_so, thoi_gian, le_phi, dia_diem, gio_cat_off, can_cu_phap_ly, nguon_url, ma_thu_tuc
RECORDS = [
    (0, "Đăng ký kết hôn", "Hộ tịch", "Cấp Xã", "", "Tờ khai, giấy tờ (bản sao, bản chính), ảnh", "05 ngày", "Miễn phí", "29 Lê Văn Việt", "", "Luật Hộ tịch", "http://x.vn/1", "TT-9"),
    (1, "Đăng ký khai sinh", "Hộ tịch", "Cấp Xã", "UBND phường Tăng Nhơn Phú", "", "", "", "", "11h30", "Luật Hộ tịch 2014", "", ""),
    (2, "", "Đất đai", "", "", "", "", "", "", "", "", "", ""),
    (3, "Cấp căn cước công dân", "Căn cước", "", "Công an", "Tờ khai", "07 ngày", "30.000 đồng", "Công an quận", "", "", "", "TT-4"),
    (4, "Chứng thực hợp đồng xây dựng", "", "Cấp Huyện", "", "Hợp đồng, căn cước", "", "50.000đ", "tại phường Tăng Nhơn Phú", "", "", "", ""),
]
