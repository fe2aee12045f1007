"""Names that tell a corpus rather than a language: places, media, persons."""

from __future__ import annotations

_PLACES = """
بحرين عمان كويت قطر يمن عراق فلسطين اردن لبنان سوريا موريتانيا سودان مصر ليبيا جزائر جزاير مغارب مغرب تونس امارات سعوديه
سليانه زغوان منوبه اريانه بنعروس جربه توزر مدنين قفصه منستير نابل قيروان قابس بنزرت سوسه صفاقس
ناظور تطوان مكناس وجده اكادير طنجه فاس مراكش رباط ورقله بليده وزو تيزي بجايه تلمسان باتنه سطيف عنابه قسنطينه وهران
درنه زاويه سبها مصراته بنغازي طرابلس بغداد دمشق بيروت دبي رياض اسكندريه قاهره
"""
_MEDIA = "هاشتاق ريتويت تغريده تغريد واتساب تيكتوك انستغرام انستقرام تويتر يوتيوب فايسبوك فيسبوك دزاير هسبريس حنبعل موزاييك"
_PERSONS = "صالحه الطاهر بشير وسيم سهيل هيثم انيس عصام مروان زياد غازي معز منجي حمادي شكري نزار الهادي منصف بلقاسم سفيان ياسين مصطفي جعفر لطفي"
#: Common words first of all, though they name places or media too.
AMBIGUOUS = frozenset("مشرق خليج سلا جده وليدي بيضاء بيضا شروق جوهره زيتونه سميره وطنيه بيان حوار شمس نهار".split())
ENTITIES = tuple(sorted({*_PLACES.split(), *_MEDIA.split(), *_PERSONS.split()} - AMBIGUOUS))
#: Longest first.
PREFIXES = tuple("وال فال بال كال لل ال و ف ب ك ل".split())
SUFFIXES = tuple("يين يات يه ين ات ي ه".split())
