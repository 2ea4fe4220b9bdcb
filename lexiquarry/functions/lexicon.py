"""Word lists, tables and patterns of the clinical-entity rules.

All values in this module are fixed values: results depend on every one of them.
Spellings that contain combining marks are added by `both_forms` where input may be decomposed.
"""

from __future__ import annotations

import unicodedata

SYMPTOM, TEST, RESULT, DIAGNOSIS, DRUG = "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"
TYPES = (SYMPTOM, TEST, RESULT, DIAGNOSIS, DRUG)
LINKED_TYPES = (DIAGNOSIS, DRUG)
ASSERTED_TYPES = (SYMPTOM, DIAGNOSIS, DRUG)
FLAGS = ("isNegated", "isFamily", "isHistorical")
PROMPT_FLAGS = ("isHistorical", "isNegated", "isHypothetical")
TYPE_PRIORITY = {DIAGNOSIS: 5, DRUG: 4, SYMPTOM: 3, TEST: 2, RESULT: 1}

# Common terms and the names that dictionaries have for them.
SYNONYMS_FULL = {
    "tiểu đường": "đái tháo đường",
    "tieu duong": "đái tháo đường",
    "tiểu đường type 2": "đái tháo đường không phụ thuộc insuline",
    "tiểu đường típ 2": "đái tháo đường không phụ thuộc insuline",
    "tiểu đường tuýp 2": "đái tháo đường không phụ thuộc insuline",
    "tiểu đường type 1": "đái tháo đường phụ thuộc insuline",
    "tieu duong type 2": "đái tháo đường không phụ thuộc insuline",
    "đái tháo đường type 2": "đái tháo đường không phụ thuộc insuline",
    "đái tháo đường típ 2": "đái tháo đường không phụ thuộc insuline",
    "đái tháo đường tuýp 2": "đái tháo đường không phụ thuộc insuline",
    "tăng huyết áp": "tăng huyết áp",
    "tăng ha": "tăng huyết áp",
    "cao huyết áp": "tăng huyết áp",
    "nhồi máu cơ tim": "nhồi máu cơ tim cấp",
    "tai biến": "tai biến mạch máu não",
    "đột quỵ": "tai biến mạch máu não",
    "rung nhĩ": "rung và cuồng nhĩ",
    "rung nhĩ và nhịp nhanh trên thất": "rung và cuồng nhĩ",
    "suy tim": "suy tim",
    "suy tim sung huyết": "suy tim sung huyết",
    "viêm bao tử": "viêm dạ dày",
    "viêm hang vị sung huyết": "viêm dạ dày",
    "viêm hang vị": "viêm dạ dày",
    "viêm dạ dày": "viêm dạ dày",
    "trào ngược dạ dày": "trào ngược dạ dày-thực quản",
    "trào ngược": "trào ngược dạ dày-thực quản",
    "xơ gan": "xơ gan",
    "xơ gan mất bù": "xơ gan",
    "viêm gan": "viêm gan",
    "viêm phổi": "viêm phổi",
    "viêm phổi bệnh viện": "viêm phổi do vi sinh vật khác",
    "bệnh phổi kẽ": "bệnh phổi kẽ khác",
    "thuyên tắc phổi": "thuyên tắc phổi",
    "thuyên tắc phổi hai bên": "thuyên tắc phổi",
    "tràn dịch màng phổi": "tràn dịch màng phổi",
    "tràn dịch màng phổi trái": "tràn dịch màng phổi",
    "tràn dịch màng phổi phải": "tràn dịch màng phổi",
    "ngưng thở khi ngủ": "ngưng thở khi ngủ",
    "áp-xe phổi": "áp xe phổi",
    "áp xe phổi": "áp xe phổi",
    "nhiễm trùng tiểu": "nhiễm khuẩn đường tiết niệu",
    "nhiễm trùng tiết niệu": "nhiễm khuẩn đường tiết niệu",
    "nhiễm trùng huyết": "nhiễm khuẩn huyết",
    "nhiễm virus herpes simplex": "nhiễm virus herpes",
    "vi-rút dại": "bệnh dại",
    "mày đay vô căn": "mày đay",
    "mày đay mạn tính": "mày đay",
    "mày đay": "mày đay",
    "nấm bẹn": "nấm da",
    "giả gout": "viêm khớp do lắng đọng tinh thể",
    "suy thận": "suy thận",
    "bệnh thận mạn": "suy thận mạn tính",
    "bàng quang thần kinh": "rối loạn thần kinh-cơ của bàng quang",
    "rối loạn lo âu": "rối loạn lo âu",
    "rối loạn cảm xúc": "rối loạn cảm xúc",
    "thiếu men g6pd": "thiếu máu do rối loạn enzym",
    "cơn rối loạn ý thức thoáng qua": "rối loạn ý thức thoáng qua",
    "đau nửa đầu": "đau nửa đầu",
    "bệnh lý đau nửa đầu": "đau nửa đầu",
    "phù gai thị": "phù gai thị",
    "ung thư vú": "u ác tuyến vú",
    "ung thư vú di căn": "u ác tuyến vú",
    "ung thư": "u ác",
    "u nang tuyến vú": "u lành tuyến vú",
    "tăng men gan": "bệnh gan",
    "tăng bilirubin máu": "rối loạn chuyển hóa bilirubin",
    "tụ máu ngoài màng cứng": "chấn thương nội sọ",
    "tụ máu ngoài màng cứng phải": "chấn thương nội sọ",
    "tụ máu ngoài màng cứng trái": "chấn thương nội sọ",
    "loét tì đè": "loét do tỳ đè",
    "loét đè ép": "loét do tỳ đè",
    "tắc ống dẫn trứng": "tắc vòi trứng",
    "teo niêm mạc tử cung": "viêm tử cung",
    "giãn thừng tinh": "giãn tĩnh mạch thừng tinh",
    "động mạch vành": "bệnh tim do thiếu máu cục bộ mạn",
    "bệnh graves": "nhiễm độc giáp",
    "graves": "nhiễm độc giáp",
    "cường giáp": "nhiễm độc giáp",
}
SYNONYMS_SHORT = {
    "tiểu đường": "đái tháo đường",
    "tieu duong": "đái tháo đường",
    "tiểu đường type 2": "đái tháo đường không phụ thuộc insuline",
    "tiểu đường type 1": "đái tháo đường phụ thuộc insuline",
    "tiểu đường tuýp 2": "đái tháo đường không phụ thuộc insuline",
    "tieu duong type 2": "đái tháo đường không phụ thuộc insuline",
    "đái tháo đường type 2": "đái tháo đường không phụ thuộc insuline",
    "đái tháo đường tuýp 2": "đái tháo đường không phụ thuộc insuline",
    "tăng huyết áp": "tăng huyết áp",
    "tăng ha": "tăng huyết áp",
    "cao huyết áp": "tăng huyết áp",
    "nhồi máu cơ tim": "nhồi máu cơ tim cấp",
    "tai biến": "tai biến mạch máu não",
    "đột quỵ": "tai biến mạch máu não",
    "viêm phổi": "viêm phổi",
    "nhiễm trùng tiểu": "nhiễm khuẩn đường tiết niệu",
    "nhiễm trùng tiết niệu": "nhiễm khuẩn đường tiết niệu",
    "g6pd": "thiếu máu do thiếu men glucose-6-phosphate dehydrogenase",
    "thiếu men g6pd": "thiếu máu do thiếu men glucose-6-phosphate dehydrogenase",
    "thieu men g6pd": "thiếu máu do thiếu men glucose-6-phosphate dehydrogenase",
    "tha": "tăng huyết áp",
}
DRUG_BLACKLIST = (
    "hệ sau", "hệ 1", "hệ 2", "hệ trước", "bậc thấp", "bậc cao", "tiêm", "tiêm vaccine", "tiêm chủng",
    "thuốc chống trầm cảm", "thuốc giảm đau opioid", "kháng histamin h1", "corticosteroid bôi tại chỗ", "thuốc",
)
# Patterns of the normalisers, in Java's syntax.
VARIANT_WORDS = r"(?U)\b(típ|tuýp|loại)\b"
PARENTHESES = r"(?U)\s*\([^)]*\)\s*"
DOSE_LONG = r"(?iU)[\d.,]+\s*(mg|ml|mcg|g|iu|%|viên|ống|gói)(/\s*(ml|kg|m2))?"
DOSE_SHORT = r"(?iU)[\d.,]+\s*(mg|ml|mcg|g|iu|%)(/\s*(ml|kg|m2))?"
DIAGNOSIS_PREFIX = r"(?U)^(bệnh nhân bị|bệnh lý|tiền sử bị|mắc bệnh|chẩn đoán|nghi ngờ|bệnh)\s+"
TRAILING_QUALIFIER = r"(?U),\s*(không đặc hiệu|không xác định|chưa xác định)$"
KEY_PREFIX = r"(?iU)^(bệnh lý|bệnh|hội chứng|rối loạn|tình trạng|nhiễm|tổn thương)\s+"
# Words that were glued together, with their repair.
GLUED_WORDS = {
    "bịchảy": "bị chảy",
    "bịho": "bị ho",
    "bịsốt": "bị sốt",
    "bịngứa": "bị ngứa",
    "bịnôn": "bị nôn",
    "đauđầu": "đau đầu",
    "đauhọng": "đau họng",
    "đaubụng": "đau bụng",
    "đaugực": "đau ngực",
    "đaulưng": "đau lưng",
    "đaukhớp": "đau khớp",
    "chảymáu": "chảy máu",
    "nổimề": "nổi mề",
    "đáitháo": "đái tháo",
}
GLUED_WORDS_ENSEMBLE = {
    "bịchảy": "bị chảy",
    "bịho": "bị ho",
    "bịsốt": "bị sốt",
    "bịngứa": "bị ngứa",
    "bịnôn": "bị nôn",
    "đauđầu": "đau đầu",
    "đauhọng": "đau họng",
    "đauhụng": "đau bụng",
    "đaugực": "đau ngực",
    "đaulưng": "đau lưng",
    "đaukhớp": "đau khớp",
    "chảymáu": "chảy máu",
    "nổimề": "nổi mề",
    "đáitháo": "đái tháo",
}
# The cleaning rules of entity spans.
EDGE_MARKS = ".,:;-–—_/+*()[]{}"
PREFIXES = ("là ", "bị ", "và ", "thì ", "bởi ", "do ", "đã thực hiện ", "thực hiện ", "tiến hành ", "đã chụp ", "chụp ", "đã làm ", "kết quả ")
PREFIXES_ENSEMBLE = ("là ", "bị ", "và ", "thì ", "do ")
DATE_SUFFIXES = (
    r"\s+vào\s+ngày\s+\[?ngày\]?",
    r"\s+vào\s+ngày\s+\d+/\d+/\d+",
    r"\s+vào\s+ngày\s+\d+-\d+-\d+",
    r"\s+ngày\s+\[?ngày\]?",
    r"\s+ngày\s+\d+/\d+/\d+",
    r"\s+ngày\s+\d+-\d+-\d+",
    r"\s+vào\s+ngày\s+.*$",
)
TEST_KEYWORDS = (
    "cholangiogram", "sinh thiết", "siêu âm", "chụp x-quang", "chụp xquang", "x-quang", "điện tâm đồ", "ecg",
    "xét nghiệm máu", "cấy máu", "cấy nước tiểu", "chụp x quang", "lấy mẫu bằng bàn chải",
)
COMMON_SYMPTOMS = (
    "đau", "sốt", "ho", "ngứa", "nôn", "mệt", "ớn lạnh", "khó thở", "chóng mặt", "đau đầu", "đau ngực", "đau bụng", "buồn nôn",
    "mệt mỏi", "đánh trống ngực", "bí tiểu", "tiêu chảy", "táo bón", "chướng bụng", "dịch báng",
)
DOSE_UNITS = ("viên", "ống", "gói", "lần", "mg", "ml", "g", "mcg", "v", "l", "gram", "gr")
SINGLE_DIAGNOSES = ("gout", "lao", "trĩ")
SINGLE_SYMPTOMS = ("ho", "sốt", "đau", "ngứa", "phù", "run", "mệt", "nôn", "nấc", "xỉu", "co", "giật", "khò", "khè", "táo", "lỏng", "bí", "trướng", "báng")
SINGLE_OTHERS = ("gel", "men", "cồn", "mỡ", "kem", "tiêm", "truyền", "mổ", "chọc", "phết")
ENTITY_BLACKLIST = (
    "thiết lập", "sử dụng", "chỉ định", "định lượng", "hướng dẫn", "theo dõi", "điều trị", "phát hiện", "chẩn đoán", "nghi ngờ", "phương pháp",
    "kết quả", "tiến triển", "mức độ", "giai đoạn", "khám bệnh", "nhập viện", "xuất viện", "po bid", "po", "bid", "tid", "qd", "qhs", "mg", "ml",
    "viên", "ống", "gói", "lần",
)
# Context keywords.
NEGATION = ("không", "chưa phát hiện", "chưa thấy", "âm tính", "không ghi nhận", "không có", "loại trừ", "chưa ghi nhận", "bình thường", "không mắc")
HISTORY = ("tiền sử", "tiền căn", "đã từng", "đã bị", "lịch sử", "cũ", "năm ngoái", "trước kia", "phát hiện từ")
FAMILY = ("gia đình", "bố", "mẹ", "cha", "ông", "bà", "di truyền", "dòng họ", "chú", "dì", "cậu", "mợ", "chị gái", "anh trai", "em gái", "em trai")
FAMILY_ENSEMBLE = ("bố", "mẹ", "ông", "bà", "cha", "anh", "chị", "em", "di truyền", "gia đình")
# The repair of symptoms that were taken for diagnoses.
RESTORED_SYMPTOMS = (
    "đau", "sốt", "ho", "ngứa", "nôn", "mệt", "ớn lạnh", "khó thở", "chóng mặt", "đau đầu", "đau ngực", "đau bụng", "buồn nôn", "mệt mỏi",
    "đánh trống ngực", "bí tiểu", "tiêu chảy", "táo bón", "chướng bụng", "dịch báng", "ho khan", "ho có đờm", "ho đờm xanh", "khó nuốt",
    "nuốt nghẹn", "tím tái", "ngất", "choáng", "đau thượng vị", "ợ hơi", "ợ chua", "đau thắt ngực", "yếu liệt", "liệt", "mất phản xạ", "sưng",
    "tấy đỏ", "mất ngủ", "lo âu",
)
KEPT_DIAGNOSES = ("u ác buồng trứng", "viêm gan", "gút", "gout", "tiểu đường", "đái tháo đường", "xơ gan", "nhồi máu cơ tim")
# Terms that are symptoms beyond doubt.
PLAIN_SYMPTOMS = ("khó thở", "ho", "sốt", "đau ngực", "đau đầu", "đau bụng", "buồn nôn", "mệt mỏi", "chóng mặt", "đánh trống ngực")
# Likely false positives.
FALSE_EXACT = (
    "men", "men g6pd", "đậu tằm", "long não", "băng phiến", "di truyền", "bệnh di truyền lặn", "không có cải thiện", "không cải thiện",
    "chưa cải thiện", "bình thường", "tiền sử bệnh", "bệnh sử", "nhập viện", "xuất viện", "hôm nay", "ngày hôm nay", "tuần tới", "sau đó",
    "ở nhà", "bác sĩ", "bệnh nhân", "người bệnh", "phòng khám", "bệnh viện", "khoa cấp cứu", "vận động", "gắng sức", "luyện tập", "thể dục",
    "công việc", "căng thẳng",
)
FALSE_PATTERNS = (r"^ngày\s+\d+", r"^lúc\s+\d+", r"^\d+\s+ngày", r"^\d+\s+tháng", r"^\d+\s+năm", r"^vs\d+", r"\d{5}\s+\d+")
# Labels of BIO tags, in the order of their ids.
BIO_LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))


def both_forms(words: tuple[str, ...] | list[str]) -> list[str]:
    """The words composed and decomposed, each once."""
    return list(dict.fromkeys(f for w in words for f in (unicodedata.normalize("NFC", w), unicodedata.normalize("NFD", w))))
