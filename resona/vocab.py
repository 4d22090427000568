"""Label vocabularies, patterns, weights and thresholds.

All of them must equal the published label handbook and rules for results to match,
so they are stated here as plain data.
"""

from __future__ import annotations

LABEL_SET_VERSION = "v1.0"

# The twelve topics and the description text of each centroid.
TOPIC_TEXT = {
    "角色设计与美术": "角色立绘 建模 服装 动作 配音 美术风格 好看 丑 出新角色",
    "战斗与玩法": "战斗机制 操作 手感 玩法 战斗系统 新机制 连招 闪避 格挡",
    "剧情与世界观": "剧情 主线 支线 文案 世界观 设定 剧情演出 结局 角色故事",
    "地图与探索": "新地图 探索 解谜 宝箱 地图设计 场景 音乐 风景 跑图",
    "版本内容量": "版本内容 内容量 长草 更新频率 没内容 内容太少 一天肝完",
    "活动设计": "活动 限时活动 活动玩法 活动奖励 活动门槛 打活动 活动太难太简单",
    "养成与资源": "圣遗物 声骸 养成 体力 素材 资源 树脂 刷本 毕业词条",
    "抽卡与商业化": "抽卡 卡池 保底 歪 定价 礼包 月卡 付费 皮肤价格 售价",
    "平衡与强度": "强度 数值 平衡 深渊 满星 角色强弱 数值膨胀 泛用性 T0",
    "性能与缺陷": "卡顿 掉帧 闪退 bug 优化 发热 网络 延迟 修复 补丁",
    "界面与便利性": "界面 UI 菜单 操作不便 跳过 一键 便利性 快捷 图标 小地图",
    "官方沟通与社区生态": "官方 公告 回应 补偿 社区 节奏 舆论 UP主 玩家吵架 官方装死",
}
TOPICS = list(TOPIC_TEXT)
NEW_TOPIC_PATTERN = r"^new:(?s:.)"

# Label sets.
SUPPORT, OPPOSE, NEUTRAL, MIXED, UNCLEAR = "支持", "反对", "中立", "混合", "不明确"
STANCES = [SUPPORT, OPPOSE, NEUTRAL, MIXED, UNCLEAR]
EMOTIONS = ["喜悦", "期待", "惊讶", "失望", "愤怒", "焦虑", "调侃玩梗", "无明显情绪"]
IRONY = ["无", "可能", "明显", "无法判断"]
INTENTS = ["称赞", "体验陈述", "问题报告", "改进建议", "提问", "玩梗", "冲突回应", "传闻讨论"]
ISSUE_TYPES = ["内容不足", "设计分歧", "数值争议", "技术故障", "奖励争议", "沟通问题", "社区冲突", "其他"]
CATEGORIES = ["official", "guide", "review", "fanwork", "controversy"]
IRONY_TO_REVIEW = ["明显", "无法判断"]
NO_STANCE = "未标注"

# Text patterns.
LOTTERY_PATTERN = r"(抽奖|抽.{0,3}(奖|福利|卡片)|转发.{0,6}抽|关注.{0,6}抽|开奖|福利发放|中奖名单)"
AD_PATTERN = r"(加.{0,2}(微信|qq|vx)|代充|代练|低价点卡|出售账号|买号卖号|兼职|广告投放|点击链接购物)"
# Every match of a pattern above holds one of these, so texts without them need no pattern search.
LOTTERY_LITERALS = ["抽", "开奖", "福利发放", "中奖名单"]
AD_LITERALS = ["加", "代充", "代练", "低价点卡", "出售账号", "买号卖号", "兼职", "广告投放", "点击链接购物"]
TRADE_PATTERN = r"(出售账号|收售|出号|换绑|租号)"
MENTION_PATTERN = r"@([^\s@，。,！!？?]{1,30})"
CONTACT_PATTERN = r"(?i)(?:QQ|vx|微信|V信)[:：\s]*[0-9a-zA-Z_\-]{5,}"
UID_PATTERN = r"(UID[:：\s]*\d{6,12}|空间号[:：\s]*\d{6,12})"
PROFILE_PATTERN = r"space\.bilibili\.com/\d+"
OVERREACH_PATTERNS = ["所有玩家", "全体玩家", "所有用户", "全网玩家", "玩家们都", "大家全都"]
CAUSAL_PATTERNS = ["导致", "造成", "致使", "引发了?玩家流失", "直接造成"]

# Field names that may not appear in a public export.
FORBIDDEN_FIELDS = [
    "uname", "mid", "uid", "avatar", "face", "avatar_url", "face_url", "user_name", "username", "profile",
    "homepage", "follower", "fans", "sex", "level", "vip", "pendant", "official", "sign",
]
# Response codes that signal a refused request.
RISK_CODES = [-412, -352, -411, 9, -799]

# Composite weights.
ISSUE_WEIGHTS = {
    "oppose_intensity": 0.30,
    "topic_share": 0.25,
    "growth": 0.20,
    "engagement": 0.15,
    "persistence": 0.10,
}
OPPORTUNITY_WEIGHTS = {
    "support_rate": 0.35,
    "topic_growth": 0.25,
    "video_coverage": 0.20,
    "engagement": 0.10,
    "persistence": 0.10,
}
WEIGHTS = {"issue": ISSUE_WEIGHTS, "opportunity": OPPORTUNITY_WEIGHTS}

# Thresholds.
OVERLENGTH_CHARS = 2000
REQUEST_CHARS = 1200
EXCERPT_CHARS = 80
REVIEW_CHARS = 300
MIN_CLUSTER_SIZE = 5
ASSIGN_THRESHOLD = 0.55
MIN_CONFIDENCE = 0.60
LIKE_QUANTILE = 0.95
AUDIT_RATIO = 0.05
SMALL_SAMPLE = 30
NEAR_DUP_RATIO = 0.85
TARGETS = {"relevance": 0.90, "topics": 0.70, "stance": 0.75, "emotion": 0.65, "irony": 0.60}

# Source column aliases per canonical field.
COLUMN_ALIASES = {
    "text": ["text", "content", "评论", "评论内容", "正文", "message", "body", "comment", "msg"],
    "published_at": ["published_at", "publish_time", "ctime", "时间", "评论时间", "发布时间", "created_at", "time",
                     "datetime", "date"],
    "source_url": ["source_url", "url", "链接", "来源", "视频链接", "source", "link"],
    "post_id": ["post_id", "rpid", "id", "评论id", "comment_id"],
    "video_id": ["video_id", "bvid", "bv号", "avid", "视频id"],
    "parent_id": ["parent_id", "parent", "root", "父评论", "reply_to"],
    "likes": ["likes", "like", "点赞", "点赞数", "like_count", "赞"],
    "reply_count": ["reply_count", "replies", "回复数", "回复"],
    "user_key": ["user_key", "uid", "mid", "用户id", "user_id", "author"],
    "dedup_group": ["dedup_group", "去重组"],
}
REQUIRED_COLUMNS = ["text", "published_at", "source_url"]
# Short keys of label batches.
BATCH_KEYS = {
    "r": "relevant", "t": "topics", "s": "stance", "e": "emotion", "i": "intensity",
    "y": "irony", "n": "intent", "q": "issue_type", "c": "confidence", "a": "abstain_reason",
}
REVIEW_FIELDS = ["relevant", "topics", "stance", "emotion", "intensity", "irony", "intent", "issue_type"]

# Claim sentence formats.
ISSUE_CLAIM = "在所采样的 B 站讨论中，『%s』为本版本重点运营问题方向，净支持率 %s，争议度 %s，样本 %d 条%s"
OPPORTUNITY_CLAIM = "在所采样的 B 站讨论中，『%s』为本版本正向机会方向，支持率 %s，视频覆盖 %d 个，样本 %d 条%s"
SMALL_SAMPLE_MARK = "（小样本）"
NOT_AVAILABLE = "不可用"
#: Where a study has no training row to take it from.
BASELINE_THRESHOLD = 0.30
