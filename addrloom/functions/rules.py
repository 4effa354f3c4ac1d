"""Word lists, patterns and thresholds of the rules. All are fixed values that results depend on."""

NOISE = "高压 中压 低压 高压A 高压B 中压A 中压B 低压A 低压B 高压a 高压b 中压a 中压b 低压a 低压b nan NaN NAN null NULL None NONE _A _B _a _b".split()
PLACEHOLDERS = "无单元 无号 无楼 无栋 无门 无室 无层 无门牌 无门牌号 无编号 无房号 暂无 未知 不详 待定".split()
ADDRESS_WORDS = (
    "号 栋 楼 层 室 单元 幢 座 门 排 户 期 小区 花园 公寓 大厦 广场 中心 城 苑 园 庄 庭 府 湾 郡 岸 里 坊 阁 居 家园 嘉园 佳园 "
    "名城 新城 家属院 宿舍 回迁 安置 尊府 超市 商店 店 公司 厂 企业 集团 有限 商城 市场 医院 学校 学院 大学 酒店 宾馆 银行 餐厅 饭店 "
    "食堂 车间 仓库 锅炉 门脸 底商 路 道 街 巷 胡同 弄 平房 别墅 物流 清真寺 食品 门站 调压"
).split()
VILLAGE_WORDS = "镇 乡 村 街道 社区 屯 庄 营 寨 办事处".split()
DEVICE_WORDS = (
    "管路 管线 支线 支管 分线 分支 阀室 阀门 阀井 调压 调压站 调压柜 调压箱 调峰 机房 配电室 泵房 井 井室 站房 加气站 门站 "
    "压力计 供水 回水 供热站 热力站 锅炉房 热源厂"
).split()
POI_SUFFIXES = (
    "小区 家属院 社区 花园 家园 生活区 广场 大厦 大楼 公园 商城 市场 商厦 城邦 府 苑 城 园 号院 公寓 里 村 庄 屯 乡 镇 街 路 "
    "工业园 产业园 学院 大学 学校 医院 中心 公司 厂"
).split()
PURE_ADMIN = "|".join((
    "^[一-龥]{2,10}(省|自治区)$",
    "^[一-龥]{2,10}市$",
    "^[一-龥]{2,10}(区|县)$",
    "^[一-龥]{2,10}(省|自治区)[一-龥]{2,10}市$",
    "^[一-龥]{2,10}市[一-龥]{2,10}(区|县)$",
    "^[一-龥]{2,10}(省|自治区)[一-龥]{2,10}市[一-龥]{2,10}(区|县)$",
))
ADMIN_NAME = "^.+(省|市|区|县|乡|镇|街道办事处|街道)$"
ADDRESS_COLUMNS = "location address userlocati housingest addr 地址 位置 住址 loc".split()
BUILDING_COLUMNS = "buildingno houseno unit floor room 楼 栋 单元 门牌 房号 层".split()
BUILDING_WORDS = "栋 号 楼 单元 层 室 排 户 期".split()
#: (field type, category) -> parts of names, in the order in which they are tried.
ADDRESS_FIELDS = {
    "province": "省 province prov 省份".split(), "city": "市 city 地级市".split(), "district": "区 district 县 旗 自治区".split(),
    "street": "街道 street 街 路 道 巷 弄".split(), "address": "地址 address 详细地址 全地址".split(), "building": "楼 building 号 栋".split(), "community": "社区 community 小区 园区".split(),
}
ID_FIELDS = {
    "id": "id uid 编号 代码 code".split(), "name": "name 名称 姓名".split(), "phone": "phone tel telephone 电话 手机".split(),
    "email": "email mail 邮箱".split()
}
REASONS = ("全空行", "清洗后为空", "纯行政区")
THRESHOLDS = {
    "high": 98.0, "high_same_district": 95.0, "review_low": 90.0, "review_high": 98.0, "mismatch_extra": 5.0,
    "poi_strong": 90.0, "poi_weak": 75.0, "semantic_strong": 0.82, "semantic_weak": 0.75, "overlap_03": 15.0,
    "overlap_05": 8.0
}


def any_of(words: list[str]) -> str:
    return "|".join(words)
