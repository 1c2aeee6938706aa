"""The category of a product by words in its name: fixed values."""

from __future__ import annotations

OTHER = "其他"
CATEGORIES = ["便當", "鹹食", "泡麵", "麵包", "甜點", "冰品", "飲料", "乳品", "零食", "周邊", OTHER]

# Words of each category, in the order in which categories are tried.
WORDS = {
    "周邊": ["捏捏球", "吊飾", "積木", "置物箱", "春聯袋", "盲盒", "杯組", "招牌", "公仔", "玩具", "文具", "週邊", "襪套", "不沾鍋", "平底鍋", "湯鍋", "炒鍋", "鍋具", "安全帽"],
    "冰品": ["酷聖霜", "霜淇淋", "雪糕", "冰棒", "冰淇淋", "雪餅", "冰沙", "冰品", "聖代", "甜筒", "雪燒", "冰磚", "酷繽沙", "檸檬繽球", "繽球"],
    "飲料": ["拿鐵", "咖啡", "奶茶", "紅茶", "綠茶", "烏龍", "茶園", "豆漿", "牛奶", "鮮奶", "果汁", "汽水", "可樂", "啤酒", "思樂冰", "可可", "美式", "卡布", "氣泡", "檸檬水", "鳳梨茶", "蜜茶", "冬瓜茶", "梅子", "多多", "貝納頌", "光泉", "林鳳營", "瑞穗", "御茶園", "茶裏王", "原萃", "麥茶", "果昔", "冰茶", "水果茶", "芭樂", "檸檬綠", "鮮橙", "葡萄水", "十六茶", "濃湯", "龜記", "微醉", "純喫茶", "青茶"],
    "甜點": ["蛋糕", "泡芙", "千層", "塔", "捲", "布丁", "慕斯", "銅鑼燒", "麻糬", "大福", "鯛魚燒", "瑞士捲", "起司塔", "蛋塔", "舒芙蕾", "提拉米蘇", "半月燒", "蛋糕捲", "奶酪", "果凍", "羊羹", "甜甜圈", "鬆餅", "布蕾", "QQ球", "蕨餅", "糰子", "串糰"],
    "麵包": ["麵包", "吐司", "土司", "貝果", "餐包", "菠蘿", "可頌", "丹麥", "法國麵包", "三明治"],
    "便當": ["便當", "飯糰", "御飯糰", "炒飯", "燴飯", "丼", "排骨", "雞腿", "燒肉", "滷肉", "油飯", "炒麵", "義大利麵", "拌麵", "冷麵", "焗烤", "餐盒", "壽司", "捲餅", "燉飯", "涼麵", "燴麵", "牛腱", "沙拉", "雞飯", "鰻魚飯", "豬腳飯", "叉燒", "油雞", "鍋", "羹", "焗飯", "白醬洋芋", "洋芋", "佛跳牆", "鐵板", "牛肉麵", "獅子頭", "鰻魚", "鐵板麵"],
    "鹹食": ["熱狗", "肉包", "雞排", "鹹酥雞", "雞心", "滷味", "關東煮", "茶葉蛋", "包子", "水餃", "蒸餃", "燒賣", "肉骨茶", "披薩", "漢堡", "潤餅", "雞塊", "薯條", "雞柳", "豆腐", "雞堡", "魚排", "雞胸", "唐揚雞", "脆卷", "醬燉蛋", "天婦羅", "大亨堡", "蒲燒", "招財堡", "好多蛋"],
    "零食": ["洋芋片", "餅乾", "糖", "巧克力", "軟糖", "脆條", "乖乖", "蝦味先", "科學麵", "米果", "仙貝", "堅果", "果乾", "肉乾", "魷魚絲", "玉米片", "多力多滋", "多利多茲", "爆脆捲", "樂事"],
    "泡麵": ["泡麵", "速食麵", "杯麵", "碗麵", "拉麵", "一度贊", "來一客", "統一麵", "滿漢", "湯麵"],
    "乳品": ["優格", "優酪", "優酪乳", "鮮乳", "起司", "乳酪", "鮮奶油", "奶酪"],
}
# Of these words, those that decide.
STRONG = {
    "周邊": ["捏捏球", "吊飾", "積木", "置物箱", "盲盒", "杯組", "公仔", "玩具", "文具", "襪套"],
    "冰品": ["酷聖霜", "霜淇淋", "雪糕", "冰棒", "冰淇淋", "冰沙", "聖代", "甜筒", "酷繽沙", "繽球"],
    "飲料": ["拿鐵", "咖啡", "奶茶", "紅茶", "綠茶", "烏龍", "豆漿", "果汁", "汽水", "可樂", "啤酒", "氣泡", "檸檬水", "蜜茶", "冬瓜茶", "貝納頌", "光泉", "林鳳營", "瑞穗", "御茶園", "茶裏王", "原萃", "麥茶", "果昔", "冰茶", "水果茶", "龜記", "微醉", "純喫茶", "青茶"],
    "甜點": ["蛋糕", "泡芙", "布丁", "慕斯", "銅鑼燒", "麻糬", "大福", "鯛魚燒", "甜甜圈", "奶酪", "果凍", "蕨餅", "糰子"],
    "麵包": ["麵包", "吐司", "土司", "貝果", "餐包", "菠蘿", "可頌", "三明治"],
    "便當": ["便當", "飯糰", "御飯糰", "炒飯", "燴飯", "丼", "餐盒", "壽司", "捲餅", "燉飯", "涼麵", "雞飯", "鰻魚飯", "豬腳飯"],
    "零食": ["洋芋片", "餅乾", "軟糖", "脆條", "乖乖", "蝦味先", "科學麵", "米果", "仙貝", "堅果", "果乾", "肉乾", "魷魚絲", "玉米片", "多力多滋", "多利多茲", "樂事", "爆脆捲"],
    "泡麵": ["泡麵", "速食麵", "杯麵", "碗麵", "拉麵", "一度贊", "來一客", "統一麵", "滿漢"],
}
# Words that name a flavour as often as a kind, and so count last.
GENERIC = ["牛奶", "鮮奶", "巧克力", "可可", "草莓", "抹茶", "咖啡", "奶茶", "紅茶", "綠茶", "烏龍", "梅子", "芭樂", "葡萄", "鳳梨", "檸檬", "蘋果", "木瓜", "芒果", "起司", "乳酪", "糖", "捲"]
# What the last revision added; the former rule lacks it.
ADDED_CATEGORY = "周邊"
ADDED = {"冰品": ["檸檬繽球", "繽球"], "飲料": ["龜記", "微醉"], "便當": ["焗飯", "白醬洋芋", "洋芋"], "鹹食": ["招財堡", "好多蛋"]}


def former_words() -> dict[str, list[str]]:
    """The words before the last revision."""
    return {c: [w for w in words if w not in ADDED.get(c, [])] for c, words in WORDS.items() if c != ADDED_CATEGORY}
