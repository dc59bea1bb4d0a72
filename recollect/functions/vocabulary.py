"""The words and patterns that decide how text is read. They must equal the established ones for right results."""

from __future__ import annotations

# fixed values: words that activate a preference explicitly
EXPLICIT_KEYWORDS = (
    "不要", "别", "优先", "请用", "请使用",
    "以后", "默认", "必须", "需要", "记住", "注意",
    "should", "must", "prefer", "always", "never", "default",
)

# fixed values: parts of secrets
SENSITIVE = ("sk-", "api_key", "access_token", "auth_token", "password", "secret", "私钥", "密钥", "令牌")

# fixed values: text that was decoded wrongly twice
GARBLED = (
    "锟斤拷", "屯屯", "榛桦", "甯稿", "浠ュ悗", "闇瑕", "绉侀挜", "鐠囪蒋", "涓嶈", "涓嶅", "鍙绯绘",
    "鐧诲綍", "涓", "鎴戝簲璇ユ妸", "浣犵殑", "璇风户鎴", "蹇呴'瑕", "鍏嶅", "鎮ㄥ簲璇ユ湁", "浠栧簲璇ユ湁", "鎴栧簲璇ユ湁",
)

# fixed values: plans that were pasted in
PLAN_MARKERS = (
    "please implement this plan", "summary", "key changes", "test plan", "public interfaces", "assumptions",
    "目标是把", "本次改造", "默认采用端到端改造", "高可用改造计划",
)

# fixed values: text about tools rather than about work
LOW_VALUE = (
    "this skill should be used", "available skills", "skill.md", "<instructions>", "## skills", "source reputation",
    "context7-compatible library id", "please implement this plan", "i want to build", "i want a", "help me build",
    "请你参考", "我想搭建", "我想做一个", "抛开这个项目",
)

# fixed values: single requests
TASK_REQUESTS = (
    "帮我", "请帮我", "给我", "怎么做", "能不能", "请实现", "实现这个", "修复这个", "分析一下", "看看",
    "继续", "还有啥", "需要新建", "新增", "创建", "修改", "完善", "直接运行", "输出最后结果",
)

# fixed values: candidates of low value, besides
LOW_VALUE_CANDIDATE = (
    "please implement this plan", "this skill should be used", "available skills", "skill.md",
    "帮我", "请帮我", "怎么做", "分析一下", "继续", "还有啥",
)

# fixed values: leading words of a preference, and the hint each gives
PREFERENCES = (
    (("不要", "别", "never"), "watchout"),
    (("优先", "prefer"), "preference"),
    (("请用", "请使用", "use"), "procedure"),
    (("以后", "默认", "必须", "需要", "记住", "always", "must", "default"), "rule"),
    (("每次", "每当"), "rule"),
)

# fixed values: words of language and format, of procedures, and of projects
LANGUAGE_HINTS = ("中文", "english", "tone", "语气", "输出", "列表", "bullets", "bullet", "markdown", "格式")
PROCEDURE_HINTS = (
    "sql", "数据库", "test", "测试", "commit", "提交", "api", "controller", "service", "mcp",
    "脚本", "sync", "maven", "build", "profile", "运行", "启动",
)
PROJECT_HINTS = (
    "repo", "repository", "模块", "module", "pom.xml", "maven", "spring boot", "controller",
    "service", "table", "sql", "数据库", "profile", "build", "test",
)
CAUTIONS = ("注意", "小心", "别忘了")

# fixed values: tags that are no topic of their own
GENERIC_TAGS = ("shared", "watchout", "preference", "procedure", "rule", "fact", "profile", "procedural", "semantic", "episodic")

# fixed values: words that forbid and words that ask for
NEGATIVE = ("never", "do not", "don't", "avoid", "forbid", "ban", "disable", "不要", "禁止", "避免")
POSITIVE = ("always", "must", "prefer", "enable", "adopt", "should", "应该", "优先", "必须")

# fixed values: what an issue says ({} is its subject), and what it suggests
ISSUE_MESSAGES = {
    "weak_evidence": "Memory `{}` has weak or missing evidence.",
    "missing_project_key": "Project-scoped memory `{}` is missing project_key.",
    "overbroad_topic": "Topic `{}` is broad and may need splitting.",
    "orphan": "Memory `{}` is on no topic's and no project's page.",
    "orphan_page": "Stale wiki page `{}` is no longer linked from the generated graph.",
    "conflicting_topic": "Topic `{}` has conflicting guidance inside project `{other}`.",
    "duplicate_concept": "Two memories look like duplicate expressions of the same concept.",
}
ISSUE_ACTIONS = {
    "weak_evidence": "Review the memory and attach stronger excerpts before treating it as durable knowledge.",
    "missing_project_key": "Backfill project_key so the memory can be routed into a project page.",
    "overbroad_topic": "Split this topic into narrower tags or add more specific labels.",
    "orphan_page": "Delete the stale page or rebuild the wiki to clean it up.",
    "conflicting_topic": "Review these memories and keep only the current rule or mark one as contradicted.",
    "duplicate_concept": "Consider merging these memories or keeping the higher quality one.",
}

# fixed values: headings of the type pages
TYPE_LABELS = {"profile": "Profiles", "procedural": "Procedures", "semantic": "Patterns", "episodic": "Episodes"}

# fixed values: words of decisions, and of insights (those that make a message worth reading, those that a sentence must hold)
DECISIONS = ("决定", "采用", "选择", "我们用", "使用", "decide", "adopt", "choose", "use", "we will", "结论是", "因此", "最终", "选择方案")
INSIGHT_MESSAGES = ("发现", "关键", "重要的是", "需要记住", "insight", "important", "key point")
INSIGHT_SENTENCES = ("发现", "关键", "重要", "insight", "important", "key", "记住")
FOLLOW_UPS = ("可以进一步", "下一步", "未来", "有待", "还需要", "后续探索", "future", "next step", "explore", "investigate", "later", "to do", "待研究", "待探索")

# fixed values: categories by the first list that matches
CATEGORIES = (
    ("debug", ("bug", "error", "修复", "调试", "fix")),
    ("creation", ("创建", "实现", "写", "build", "create", "implement")),
    ("learning", ("学习", "理解", "研究", "learn", "understand")),
    ("decision", ("决策", "选择方案", "architecture", "设计")),
)
TASK_CATEGORIES = (
    *CATEGORIES,
    ("testing", ("测试", "test", "验证", "verify")),
    ("deployment", ("部署", "deploy", "发布", "release")),
)

# fixed values: tools and tags, with the words that suggest them
REQUIRED_TOOLS = (
    ("git", ("git", "commit", "branch", "push", "pull")),
    ("shell", ("bash", "sh", "powershell", "cmd", "terminal", "终端")),
    ("docker", ("docker", "container", "镜像", "容器")),
    ("npm", ("npm", "node_modules", "package.json")),
    ("python", ("python", "pip", "venv", "__pycache__")),
    ("api", ("api", "http", "rest", "endpoint", "接口")),
    ("database", ("sql", "database", "mysql", "postgres", "sqlite", "数据库")),
    ("docker-compose", ("docker-compose", "compose")),
)
SUGGESTED_TAGS = (
    ("fastapi", ("fastapi", "uvicorn")),
    ("react", ("react", "jsx", "tsx", "useeffect", "usestate")),
    ("python", ("python", "pip", "venv")),
    ("typescript", ("typescript", "ts-", "interface", "type ")),
    ("git", ("git", "commit", "branch")),
    ("docker", ("docker", "container")),
    ("api", ("api", "endpoint", "rest")),
    ("database", ("sql", "database", "query")),
    ("testing", ("test", "pytest", "unittest", "测试")),
    ("debug", ("debug", "error", "exception", "bug")),
    ("deployment", ("deploy", "ci/cd", "github actions", "部署")),
    ("config", ("config", "yaml", "json", "toml", "配置")),
    ("frontend", ("css", "html", "ui", "component", "组件")),
    ("backend", ("server", "api", "controller", "service")),
)
SKILL_REQUESTS = ("把这个固化成技能", "把这个流程固化为技能", "create a skill", "extract as skill", "save as skill", "固化", "保存为技能")
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "我", "的", "是", "在", "和", "了", "要", "做", "请", "一个",
)

# fixed values: notes by type, most hits first, then this order
NOTE_TYPES = (
    ("复盘", ("复盘", "总结", "教训", "踩坑", "postmortem", "retro", "retrospective", "lessons learned")),
    ("计划", ("计划", "方案", "实施", "步骤", "milestone", "roadmap", "plan", "rollout")),
    ("需求", ("需求", "目标", "约束", "success criteria", "need", "must have", "requirement")),
    ("规则", ("默认", "以后", "必须", "不要", "优先", "always", "never", "prefer", "rule")),
    ("决策", ("决策", "决定", "取舍", "tradeoff", "decision", "choose", "chosen", "adopt")),
)
HIGH_VALUE = (
    "需求", "目标", "success criteria", "计划", "方案", "步骤", "里程碑", "decision", "decide", "决策", "取舍", "复盘",
    "总结", "教训", "踩坑", "规则", "默认", "以后", "必须", "不要", "优先", "always", "never", "prefer",
)
# fixed values: what a note written by hand must hold one of to be imported; folders of a project's notes by type
IMPORT_MARKERS = (
    "决策", "规则", "偏好", "记住", "应该", "不要", "目标", "决定", "取舍", "原则", "规范", "convention", "rule", "prefer",
    "decision", "pattern", "## 结论", "## 决策",
)
NOTE_FOLDERS = {"需求": "01-需求", "计划": "02-计划", "决策": "03-决策", "复盘": "04-复盘"}
NOTE_LOW_VALUE = ("available skills", "skill.md", "<instructions>", "please implement this plan", "help me build", "this skill should be used")
SECTION_TOKENS = ("summary", "key changes", "test plan", "assumptions", "背景", "目标", "下一步")
LESSON_NOISE = (
    "<proposed_plan>", "available skills", "this skill should be used", "please implement this plan", "我先", "我会",
    "我准备", "接下来", "先检查", "先确认", "我在", "我刚", "已经补上", "现在先", "测试没跑出来",
)
LESSON_SIGNALS = (
    "复盘", "教训", "经验", "风险", "原因", "根因", "避免", "下次", "应该", "不要", "必须", "默认", "结论",
    "tradeoff", "decision", "lesson", "risk", "root cause", "avoid",
)
LESSON_FIRST_PERSON = ("不要", "必须", "默认", "经验", "教训", "结论")

MILESTONES = (10, 25, 50, 100, 200, 500)

# fixed values: how sentences are cut, and what a path, a bullet, a generic title and code look like (for Java and RE2)
WORD = r"[\p{L}\p{N}_]"
SENTENCE_END = r"[。；;!?！？\n]+"
DECISION_END = r"[。.!?\n]"
INSIGHT_END = r"[。.!?]"
PATH_ONLY = r"^[a-zA-Z]:\\|^/|^[.~]?[/\\]|[/\\].+[/\\]"
BULLET = r"^\s*(?:[-*]\s+|#+\s+|\d+\.\s+)"
GENERIC_TITLE = r"^(?:这个|那个|问题|需求|计划|方案|项目|优化|修复|处理)(?:$|[^\p{L}\p{N}_])"
CODE = r"(?:(?:^|[^\p{L}\p{N}_])return(?:$|[^\p{L}\p{N}_])|->|\.stream\(|Collectors\.|public\s+class|@[\p{L}\p{N}_]+|[{};]{2,})"
#: One of these stands in all text that CODE finds.
CODE_SIGNS = ("return", "->", ".stream(", "Collectors.", "public", "@", "{", "}", ";")
GARBLED_QUESTION = r"[A-Za-z\x{4e00}-\x{9fff}]\?(?:[,.\s]|$)"

# fixed values: the documents of a week: name and title, sections (heading, list, what stands for an empty one), and how they are kept
WEEKLY_DOCUMENTS = (
    (
        ("工作模式和偏好.md", "工作模式和偏好"),
        (("当前稳定模式", "habits", "暂无稳定偏好总结。"), ("本周新增观察（{week}）", "new", "本周暂无新的工作模式观察。"), ("待确认", "open", "当前没有待确认的偏好条目。")),
        ("每周自动从高价值需求、计划、规则和活跃记忆中提炼。", "只保留未来会重复使用的习惯、默认做法和协作偏好。"),
    ),
    (
        ("经验与教训.md", "经验与教训"),
        (("本周经验（{week}）", "gains", "本周暂无新的经验总结。"), ("本周教训与风险", "risks", "本周暂无新的风险或教训。"), ("可复用模式", "patterns", "暂未沉淀出可复用模式。")),
        ("只从明确复盘、明确决策、已验证规则中提炼。", "过滤过程话术、计划草稿、系统提示和没有结论的执行记录。"),
    ),
)

# fixed values: where a rule note says that it comes from, before its tool, and the tag that all rule notes have
RULE_SOURCE, RULE_TAG = "ai-memory:", "长期规则"
