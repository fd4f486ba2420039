"""Vocabularies and message templates that results depend on; EngineConfig can replace those marked as parameters."""

# Word lists, patterns and message texts.

#: Parameter. Words that signal durable facts, each counted once.
FACT_PATTERNS = ("项目", "依赖", "使用", "技术栈", "数据库", "api", "服务", "用户名", "偏好", "喜欢", "不喜欢", "叫", "名为", "fastapi", "sqlite", "postgres", "redis")
#: Parameter.
CHITCHAT_PATTERNS = ("天气", "哈哈", "你好", "在吗", "早上好", "晚安", "谢谢")

BASE_IMPORTANCE = {"identity": 0.95, "preference": 0.85, "fact": 0.7, "reflection": 0.75, "negative": 0.7, "episode": 0.35}
OTHER_IMPORTANCE = 0.5

#: Parameter. Technology stacks.
STACKS = {
    "java": ("java", "spring", "springboot", "jvm", "maven", "gradle", "hibernate"),
    "go": ("go", "golang", "gin", "echo", "fiber"),
    "python": ("python", "django", "flask", "fastapi", "pytorch"),
    "nodejs": ("node", "nodejs", "express", "nestjs", "typescript", "javascript"),
    "dotnet": (".net", "csharp", "c#", "aspnet"),
    "rust": ("rust", "actix", "axum"),
    "php": ("php", "laravel", "symfony"),
    "ruby": ("ruby", "rails"),
}
SHIFT_HINTS = "改用|换成|迁移到|切换到|新项目用|改为|采用|不是|不再用|替代"
ALERT_NEGATION = "不是|而非|不要|禁止|避免|应该是"

#: Parameter. Topics of consolidation, in order.
TOPICS = {
    "database": ("mysql", "postgresql", "postgres", "mongodb", "redis", "sqlite", "数据库"),
    "backend_lang": ("java", "spring", "golang", "python", "fastapi", "nodejs", "rust"),
    "auth": ("jwt", "oauth", "登录", "鉴权", "认证"),
}
DATABASES = ("mysql", "postgresql", "postgres", "mongodb", "sqlite")
LANGUAGES = {"java": ("java", "spring"), "golang": ("golang",), "python": ("python", "fastapi"), "nodejs": ("node", "typescript"), "rust": ("rust",)}
CONFLICT_NEGATION = "不是|而非|应该是|改为|改用"
DEFAULT_TOPIC = "相关主题"
SUMMARY_PREFIX = "【精华摘要·{}】"
FRAGMENT_JOIN = "；"

# relation extraction
RELATION_VERBS = {
    "depends_on": ("依赖于", "依赖", r"depends\s+on", r"depend\s+on"),
    "uses": ("使用", "采用", "uses", r"based\s+on"),
    "owned_by": ("拥有", "属于", r"owned\s+by"),
}
RELATION_CONFIDENCE = {"depends_on": 0.85, "uses": 0.75, "owned_by": 0.75}
TECH_NAMES = ("redis", "sqlite", "postgres", "postgresql", "mysql", "mongodb", "neo4j", "fastapi", "django", "flask", "kafka", "nginx", "docker", "kubernetes", "k8s", "qdrant", "chroma")
PERSON_NAMES = ("用户", "老板")

# reflection
CORRECTION = r"(?:应该是|应为|改成|纠正为|是)\s*(.+?)\s*(?:不是|而非|而不是)\s*(.+)$"
CORRECTION_TEXT = ("正确事实：", "（此前误为 ", "）")
IDENTITY_MARKS = "用户名|我叫|我是|identity"
TOO_SHORT = "纠正文本过短或为空，无法形成可靠修订事实。"
CORRECTED = ("用户提供了显式纠正。", "纠正原文：", "原回答片段：", "关联记忆条数：")
DOWNVOTED = ("禁忌/负例：", "以下内容曾被点踩，回答时应避免重复：", "以下回答曾被点踩，应避免重复：", "用户对某次回答点踩，但缺少可沉淀的负例文本。")
DOWNVOTE_ANALYSIS = "用户点踩，沉淀为 negative 记忆以防复发。"

# alerts
SHIFT_MESSAGE = ("检测到技术栈切换（", "→", "）。相关旧记忆：「", "」。是否要将迁移经验/对照指南也写入记忆？")
CONFLICT_MESSAGE = ("新内容可能与既有记忆冲突：「", "」。建议确认后纠正或钉死新事实。")

# host turns
FACT_HINTS = "(我(们)?(用|是|叫|偏好|喜欢)|项目|技术栈|数据库|依赖|不要|禁止|记住|以后都|请记住)"
IDENTITY_HINTS = "(我叫|用户名|我的名字|称呼我)"
IMPACT_HINTS = "(改|影响|依赖|谁会|blast|impact)"
CORRECTION_HINTS = "(不对|错了|应该是|不是.+是|纠正)"
