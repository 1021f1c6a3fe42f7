"""Fixed values of the label rules, in the order in which they are tried."""

# Labels that are not knowledge points
NON_POINT_LABELS = [
    "数学活动", "★数学乐园", "☆摆一摆，想一想", "阅读与思考", "实验与探究", "信息技术应用", "数学文化",
    "小结", "整理和复习", "本章综合与测试", "本节综合与测试", "构建知识体系", "构建知识体系和应用", "构建知识体系及练习训练", "章前引言", "知识梳理",
    "复习题", "习题训练", "测试", "单元测试", "综合练习", "试卷分析", "本册综合", "部分中英文词汇索引", "附录", "课题学习",
]
# Beginnings of such labels
NON_POINT_PREFIXES = ["阅读与思考 ", "阅读与思考　", "实验与探究 ", "实验与探究　", "信息技术应用 ", "信息技术应用　", "章前引言及", "构建知识体系及", "复习题"]
# Ends of generic chapters
GENERIC_SUFFIXES = ["（通用）", "(通用)", "（综合）", "(综合)", "（综合与测试）", "(综合与测试)"]
# Difficulty by grade
GRADE_DIFFICULTY = {"一年级": 1, "二年级": 1, "三年级": 2, "四年级": 2, "五年级": 3, "六年级": 3, "七年级": 3, "八年级": 4, "九年级": 4, "必修第一册": 4, "必修第二册": 4, "必修第三册": 5}
# Words that add to the difficulty
HARDER = ["综合", "应用", "拓展", "探究", "复杂", "推导", "证明", "推理", "分析", "混合", "复合", "进阶"]
# Words that take from it
EASIER = ["认识", "初步", "简单", "基础", "概念", "入门", "基本"]
# Words of each rank, the first that fits counting
IMPORTANCE = {
    "核心": ["概念", "定义", "定理", "公理", "原理", "法则", "公式", "性质", "规律", "加法", "减法", "乘法", "除法", "方程", "函数"],
    "重要": ["运算", "计算", "方法", "技巧", "应用", "关系", "比较", "判定", "条件", "步骤", "过程", "解法"],
    "了解": ["拓展", "阅读", "活动", "兴趣", "课外", "补充", "延伸", "选学", "实践"],
}
# Labels with their other names
SYNONYMS = {
    "加法": ["加", "加法运算", "相加", "求和"], "减法": ["减", "减法运算", "相减", "求差"], "乘法": ["乘", "乘法运算", "相乘", "求积"], "除法": ["除", "除法运算", "相除", "求商"],
    "百分数": ["百分比", "百分率"], "小数": ["小数数", "小数概念"], "分数": ["分数概念", "分数意义"], "三角形": ["三角形图形"], "正方形": ["正方形图形"], "长方形": ["矩形", "长方形图形"],
    "方程": ["方程式"], "函数": ["函数概念"], "比例": ["比例关系"], "统计": ["统计学", "统计图表"],
}
# Codes of subjects
SUBJECT_NAMES = {"数学": "math", "物理": "physics", "化学": "chemistry", "生物": "biology", "生物学": "biology", "历史": "history", "地理": "geo", "语文": "chinese", "英语": "english", "思想政治": "politics", "政治": "politics"}
# Codes of grades
GRADE_CODES = {"一年级": "g1", "二年级": "g2", "三年级": "g3", "四年级": "g4", "五年级": "g5", "六年级": "g6", "七年级": "g7", "八年级": "g8", "九年级": "g9", "必修第一册": "bixiu1", "必修第二册": "bixiu2", "必修第三册": "bixiu3"}
# Codes of semesters
SEMESTER_CODES = {"上册": "s", "下册": "x"}
# Codes of publishers
PUBLISHER_CODES = {"人民教育出版社": "renjiao", "人教版": "renjiao"}
# Words that core concepts lack
NON_CORE_WORDS = ["购物", "招聘", "营养", "水", "游戏", "故事", "活动", "经验", "意识", "能力", "素养", "问题提出", "问题抽象", "图案设计", "图案", "厚度", "尺子", "预测", "趋势"]
