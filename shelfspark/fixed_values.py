"""Values that results depend on, stated as they are."""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Encyclopaedia articles: category -> type, junk sections, technical categories.
AUTHOR_CATEGORIES = [
    "Nhà văn Việt Nam", "Nhà thơ Việt Nam", "Tác giả Việt Nam",
    "Nhà văn Hà Nội", "Tiểu sử người Việt Nam",
]
WORK_CATEGORIES = [
    "Tác phẩm văn học Việt Nam", "Tiểu thuyết Việt Nam",
    "Truyện ngắn Việt Nam", "Thơ Việt Nam", "Truyện thơ Việt Nam",
    "Kịch Việt Nam", "Ký Việt Nam", "Truyện tranh Việt Nam",
    "Sách tiếng Việt", "Sách Việt Nam", "Sách thiếu nhi Việt Nam",
    "Văn học thiếu nhi Việt Nam",
]
TECHNICAL_CATEGORY_PATTERNS = [
    r"^Bài viết có ", r"^Bản mẫu ", r"^Trang ", r"^Wikipedia:", r"^Thể loại:",
    r"mất năm \d+", r"sinh năm \d+", r"^\d{4}$", r"^Năm \d+",
]
JUNK_SECTIONS = [
    "Xem thêm", "Chú thích", "Tham khảo", "Liên kết ngoài",
    "Ghi chú", "Thư mục", "Chú giải", "Nguồn", "Tài liệu tham khảo",
]
MIN_CLEAN_CHARS = 50

# ---------------------------------------------------------------- fixed values
# Book records: kept languages, shortest text, topic lists.
KEEP_LANGS = ["vi"]
MIN_BOOK_CHARS = 20
MIN_ARTICLE_CHARS = 150
PAGE_ADDRESS = "https://vi.wikipedia.org/?curid="
CATEGORY_PREFIX = r"Thể[ _]loại:"
IRRELEVANT_KEYWORDS = [
    "học tiếng anh", "luyện thi", "foreign language study",
    "nông nghiệp", "thú y", "canh tác", "trồng trọt",
    "y học", "y tế", "dược", "bệnh viện",
    "kỹ thuật", "công nghệ", "điện tử", "tin học",
    "toán học", "vật lý", "hóa học",
    "kinh tế", "kế toán", "tài chính", "ngân hàng",
    "luật", "pháp luật",
    "nấu ăn", "ẩm thực", "cookbook",
    "du lịch", "travel guide",
    "microsoft", "excel", "word", "powerpoint", "photoshop",
    "java", "python programming", "lập trình",
]
LITERATURE_KEYWORDS = [
    "tiểu thuyết", "truyện ngắn", "truyện dài", "truyện thơ",
    "thơ", "tản văn", "bút ký", "hồi ký", "ký sự",
    "văn học", "tác phẩm", "nhà văn", "nhà thơ",
    "kịch", "tuyển tập", "truyện cổ tích", "chí phèo", "vợ nhặt",
    "fiction", "novel", "poetry", "short stories",
    "literary", "literature", "biography", "memoir",
    "việt nam", "vietnamese", "ngôn tình", "kiếm hiệp",
    "văn xuôi", "ngụ ngôn", "truyện cười", "cổ tích", "tác giả",
]

# ---------------------------------------------------------------- fixed values
# Person pages, article kind.
PERSON_CATEGORY_SIGNALS = [
    "nhà văn", "nhà thơ", "nhà viết kịch", "nhà soạn kịch", "tác giả",
    "nhà báo", "dịch giả",
]
PERSON_SUMMARY_SIGNALS = ["là nhà ", "là một nhà ", "là nhà thơ", "là nhà văn", "là cố nhà"]
ARTICLE_AUTHOR_KEYWORDS = [
    "nhà văn", "nhà thơ", "tác giả", "nhà soạn kịch",
    "nhà viết kịch", "nhà văn nữ",
]
ARTICLE_AUTHOR_SIGNALS = [
    r"\blà\s+(?:một\s+)?(?:nhà văn|nhà thơ|tác giả|nhà soạn kịch)\b",
    r"\bsinh\s+(?:ngày\s+)?\d+\s+tháng\b",
    r"\bsinh\s+năm\s+(?:19|20)\d{2}\b",
]

# ---------------------------------------------------------------- fixed values
# Metadata fields and thresholds.
CATALOG_COLUMNS = [
    "id", "title", "entity_type", "author", "publication_year", "genre", "publisher",
    "page_count", "isbn", "cover_url", "summary", "source", "source_paths",
]
FILLABLE_FIELDS = [
    "author", "publication_year", "genre", "publisher",
    "page_count", "isbn", "cover_url", "summary",
]
REPORT_FIELDS = ["author", "publication_year", "genre", "publisher", "page_count", "summary"]
ENRICH_FIELDS = ["author", "publication_year", "genre", "publisher", "page_count"]
EMPTY_MARKERS = ["none", "n/a", "null", "không rõ", "chưa rõ"]
SUMMARY_FILLED_CHARS = 50
SUMMARY_REDO_CHARS = 150
JUNK_SUMMARY_CHARS = 200
WORDS_PER_PAGE = 250
ENTITY_TEXT_CHARS = 3000
EXCERPT_CHARS = 300
BODY_EXCERPT_CHARS = 3000
BODY_LINE_CHARS = 60
UNKNOWN_AUTHOR = "Khuyết danh"
UNKNOWN_FILE_AUTHOR = "Khuyết Danh"
SOURCE_PRIORITY = ["wikipedia", "archive_compact", "gbooks"]

# ---------------------------------------------------------------- fixed values
# Genre names: ordered (substring, label); the first hit wins.
GENRE_PATTERNS = [
    ("historical fiction", "Tiểu thuyết lịch sử"),
    ("juvenile", "Văn học thiếu nhi"),
    ("children", "Văn học thiếu nhi"),
    ("short stor", "Truyện ngắn"),
    ("poet", "Thơ"),
    ("graphic novel", "Truyện tranh"),
    ("comic", "Truyện tranh"),
    ("drama", "Kịch"),
    ("play", "Kịch"),
    ("memoir", "Hồi ký"),
    ("autobiograph", "Tự truyện"),
    ("biography", "Tiểu sử"),
    ("authors", "Tiểu sử"),
    ("literary criticism", "Phê bình văn học"),
    ("literary collection", "Tuyển tập văn học"),
    ("essay", "Tản văn"),
    ("romance", "Tiểu thuyết lãng mạn"),
    ("education", "Sách giáo dục"),
    ("study", "Sách giáo dục"),
    ("textbook", "Sách giáo dục"),
    ("religion", "Tôn giáo"),
    ("buddhis", "Tôn giáo"),
    ("philosophy", "Triết học"),
    ("folk literature", "Văn học dân gian"),
    ("folklore", "Văn học dân gian"),
    ("fairy tale", "Truyện cổ tích"),
    ("legend", "Truyền thuyết"),
    ("mythology", "Thần thoại"),
    ("social science", "Khoa học xã hội"),
    ("political science", "Chính trị"),
    ("politic", "Chính trị"),
    ("business", "Kinh tế"),
    ("economic", "Kinh tế"),
    ("self-help", "Kỹ năng sống"),
    ("self help", "Kỹ năng sống"),
    ("body, mind", "Tâm linh"),
    ("mind & spirit", "Tâm linh"),
    ("psychology", "Tâm lý học"),
    ("computer", "Tin học"),
    ("technology", "Khoa học - Công nghệ"),
    ("medical", "Y học"),
    ("health", "Sức khỏe"),
    ("cooking", "Ẩm thực"),
    ("travel", "Du ký"),
    ("performing arts", "Nghệ thuật biểu diễn"),
    ("music", "Âm nhạc"),
    ("antiques", "Sưu tầm"),
    ("collectible", "Sưu tầm"),
    ("language arts", "Ngôn ngữ học"),
    ("dictionar", "Từ điển"),
    ("reference", "Sách tham khảo"),
    ("law", "Pháp luật"),
    ("generals", "Tiểu sử"),
    ("intellectual", "Tiểu sử"),
    ("science", "Khoa học"),
    ("history", "Lịch sử"),
    ("novel", "Tiểu thuyết"),
    ("fiction", "Tiểu thuyết"),
    ("indochinese war", "Lịch sử"),
    ("war", "Lịch sử"),
    ("communis", "Chính trị"),
    ("bible", "Tôn giáo"),
    ("composer", "Tiểu sử"),
    ("festival", "Văn hóa"),
    ("cultural", "Văn hóa"),
    ("relationship", "Gia đình"),
    ("chinese language", "Ngôn ngữ học"),
    ("fine art", "Mỹ thuật"),
    ("art", "Nghệ thuật"),
    ("vietnamese literature", "Văn học Việt Nam"),
    ("hanoi", "Văn học Việt Nam"),
    ("vietnam", "Văn học Việt Nam"),
    ("literary", "Văn học"),
    ("literature", "Văn học"),
]
VIETNAMESE_LETTERS = "ăâêôơưđáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
OTHER_GENRE = "Khác"
BOOK_GENRE_MAP = [
    ("fiction", "Tiểu thuyết"),
    ("novel", "Tiểu thuyết"),
    ("short stories", "Truyện ngắn"),
    ("poetry", "Thơ"),
    ("juvenile fiction", "Văn học thiếu nhi"),
    ("juvenile nonfiction", "Sách thiếu nhi"),
    ("biography", "Tiểu sử"),
    ("history", "Lịch sử"),
    ("drama", "Kịch"),
    ("literary collections", "Tuyển tập văn học"),
    ("literary criticism", "Phê bình văn học"),
]

# ---------------------------------------------------------------- fixed values
# Infobox keys and the text patterns used when there is no infobox.
INFOBOX_FIELDS = {
    "tác giả": "author", "tac gia": "author", "author": "author", "authors": "author",
    "người viết": "author", "nhà văn": "author",
    "năm phát hành": "publication_year", "năm xuất bản": "publication_year",
    "ngày xuất bản": "publication_year", "publication date": "publication_year",
    "published": "publication_year", "release date": "publication_year", "năm": "publication_year",
    "thể loại": "genre", "thể loại văn học": "genre", "genre": "genre", "loại hình": "genre",
    "sinh": "birth_year", "ngày sinh": "birth_year", "born": "birth_year",
    "mất": "death_year", "ngày mất": "death_year", "died": "death_year",
    "quốc tịch": "nationality", "nationality": "nationality", "quê hương": "nationality",
    "tác phẩm nổi tiếng": "notable_works", "notable works": "notable_works",
    "tác phẩm": "notable_works",
}
CONTENT_GENRES = [
    (r"\btiểu thuyết\b", "Tiểu thuyết"), (r"\btruyện ngắn\b", "Truyện ngắn"), (r"\btập thơ\b", "Tập thơ"),
    (r"\btrường ca\b", "Trường ca"), (r"\btruyện thơ\b", "Truyện thơ"), (r"\bkịch\b", "Kịch"),
    (r"\bhồi ký\b", "Hồi ký"), (r"\bký sự\b", "Ký sự"), (r"\btruyện cổ tích\b", "Truyện cổ tích"),
    (r"\btruyện tranh\b", "Truyện tranh"), (r"\bthơ\b", "Thơ"), (r"\bnovel\b", "Tiểu thuyết"),
    (r"\bshort story\b", "Truyện ngắn"),
]
AUTHOR_PATTERNS = [
    r"(?:của|do|viết bởi|sáng tác bởi)\s+(?:nhà văn\s+)?([A-ZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂẮẶẢẠẦỐ][^\s,\.]{1,30}(?:\s+[A-ZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂẮẶẢẠẦỐ][^\s,\.]{1,30}){0,3})",
    r"là\s+(?:một\s+)?(?:tiểu thuyết|tác phẩm|truyện ngắn|tập thơ|bài thơ|hồi ký|kịch)\s+của\s+([A-ZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂẮẶẢẠẦỐ][^\s,\.]{1,30}(?:\s+[A-ZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂẮẶẢẠẦỐ][^\s,\.]{1,30}){0,3})",
]
CONTENT_YEAR_PATTERNS = [
    r"(?:xuất bản|phát hành|ra mắt|in lần đầu|công bố)\s+(?:năm\s+)?(\b(?:19|20)\d{2}\b)",
    r"năm\s+(\b(?:19|20)\d{2}\b)\s*[,\.]?\s*(?:bởi|do|nhà xuất bản)",
    r"\((\b(?:19|20)\d{2}\b)\)",
]
YEAR_MODERN = r"\b(?:19|20)\d{2}\b"
YEAR_INFOBOX = r"\b(1[0-9]{3}|20[0-9]{2})\b"
YEAR_STRICT = r"\b(1[5-9]\d\d|20[0-2]\d)\b"
YEAR_CLAIM = r"[+-](\d{4})"
YEAR_TAG = r"\[Năm xuất bản:\s*\S"
# Infobox fields and the markup taken off their values; items of the expected-title list.
INFOBOX_FIELD = r"\|\s*([^=|\n<{}]+?)\s*=\s*([^|{}\n]*(?:\n(?![|{}]).*)*)"
WIKI_LINK = r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]"
WIKI_TEMPLATE = r"\{\{[^}]+\}\}"
WIKI_QUOTES = r"'''?"
HTML_TAG = r"<[^>]+>"
BOLD_ITEM = r"\*\*[^*]+\*\*"
TITLE_WITH_AUTHOR = r"([^,()\n]+?)\s*\(([^)]+)\)"

# ---------------------------------------------------------------- fixed values
# Knowledge-base properties used from claims.
CLAIM_PROPERTIES = {
    "author": "P50", "publication_date": "P577", "genre": "P136",
    "birth": "P569", "death": "P570", "nationality": "P27",
}

# ---------------------------------------------------------------- fixed values
# Web pages: link patterns, selectors, removed elements.
BOOK_LINK_PATTERN = r"(?i)truyen\.aspx\?tid="
VOLUME_SEARCH_PAGES = 25
CHAPTER_LINK = r"(?i)tid=.*?(chuong|chap)"
CONTENT_SELECTORS = ["#noidung", "div.truyen", "#divtoanvan", "td.chude"]
TITLE_SELECTORS = ["h1", "#tieude", "div.tualon"]
AUTHOR_SELECTORS = ["#tacgia", "div.tacgia", "a.tacgia"]
STRIPPED_ELEMENTS = ["script", "style", "noscript", "iframe", "table", "form"]
MIN_SELECTED_CHARS = 100
MIN_STORY_CHARS = 500

# ---------------------------------------------------------------- fixed values
# Answers and conversations.
CITATION_MARKERS = ["nguồn tham khảo", "📚", "[1]", "[2]", "— tác giả", "tài liệu"]
FALLBACK_MARKERS = [
    "không tìm thấy", "không đủ thông tin", "không có thông tin", "thư viện không",
    "thư viện hiện tập trung", "không tìm thấy thông tin về", "xin lỗi",
]
QUERY_TYPES = ["FACTUAL", "AUTHOR", "SEMANTIC"]
USER_LABEL, ASSISTANT_LABEL = "Người dùng", "Trợ lý"
EXPORT_USER_LABEL, EXPORT_ASSISTANT_LABEL = "👤 Người dùng", "🤖 Chatbot"
DETAIL_MARKER = "Nội dung chi tiết:"
NO_TITLE, NO_AUTHOR = "Không rõ", "Không rõ"
THIS_WORK, THIS_AUTHOR = "tác phẩm này", "tác giả này"
PROMPT_CONTEXT_HEAD = "=== [NGỮ CẢNH] — CÁC ĐOẠN VĂN BẢN LIÊN QUAN ==="
SUMMARY_EXTRA_TOKENS = 16
PROMPT_HISTORY_HEAD = (
    "=== LỊCH SỬ HỘI THOẠI (chỉ để hiểu ngữ cảnh câu hỏi, KHÔNG phải nguồn dữ kiện) ===\n"
    "Lưu ý: chỉ dùng lịch sử để hiểu các đại từ/tham chiếu trong câu hỏi "
    "(ví dụ \"tác giả đó\", \"cuốn này\"); mọi dữ kiện trong câu trả lời vẫn phải "
    "bám vào phần [NGỮ CẢNH] bên dưới.\n")
PROMPT_SUMMARY = "Tóm tắt các lượt trước đó: {v}"
PROMPT_SOURCE = "\n--- Nguồn [{n}] ---\nTài liệu: {title} | Tác giả: {author}\n{text}\n"
PROMPT_QUESTION = "\n=== CÂU HỎI ===\n{query}\n\n=== CÂU TRẢ LỜI ==="
QUESTIONS_ABOUT = [
    "Tóm tắt nội dung của '{title}'?",
    "Tác giả {author} còn viết những tác phẩm nào khác?",
    "Những tác phẩm tương tự '{title}' là gì?",
    "Ý nghĩa và giá trị của '{title}' trong văn học Việt Nam?",
    "Giai đoạn sáng tác của {author} là khi nào?",
]
QUESTIONS_GENERAL = [
    "Các tác phẩm văn học Việt Nam nổi tiếng nhất là gì?",
    "Những tác giả văn học Việt Nam tiêu biểu?",
    "Văn học Việt Nam giai đoạn 1930–1945 có những đặc điểm gì?",
]
# Headers of entity chunks and lines of book cards.
HEADER_TITLE, HEADER_AUTHOR, HEADER_YEAR = "[Tiêu đề: {v}]", "[Tác giả: {v}]", "[Năm xuất bản: {v}]"
HEADER_GENRE, HEADER_PUBLISHER, HEADER_LENGTH = "[Thể loại: {v}]", "[Nhà xuất bản: {v}]", "[Độ dài tác phẩm: ~{v} từ]"
HEADER_AI_SUMMARY = "Tóm tắt AI: {v}\n\n"
CARD_WORK, CARD_AUTHOR, CARD_GENRE, CARD_AUDIENCE = "Tác phẩm: {v}", "Tác giả: {v}", "Thể loại: {v}", "Đối tượng: {v}"
CARD_LENGTH, CARD_LANGUAGE = "Độ dài: {v} từ ({pages})", "Ngôn ngữ: Tiếng Việt"
CARD_SOURCE, CARD_EXCERPT, CARD_SUMMARY = "Nguồn: Kho lưu trữ văn học (archive)", "Trích đoạn mở đầu: {v}", "Tóm tắt: {v}"
PAGES_SHORT, PAGES_MIDDLE, PAGES_LONG, PAGES_UNKNOWN, PAGES = "truyện ngắn/thơ", "truyện vừa", "tiểu thuyết", "không rõ", "~{v} trang ({band})"
