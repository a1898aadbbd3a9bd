"""Shopping lexicons and the classifications that rest on them, as Column expressions.

The lists hold under two hundred entries each; they are compared as literal sets, so no join is planned for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that define the classes.
COLORS = tuple("""black white red blue green navy pink grey gray brown beige purple yellow orange gold silver khaki ivory
maroon teal cream tan olive burgundy coral turquoise charcoal charcoalgrey mint lavender lilac mustard rust wine rose peach
nude camel chocolate magenta fuchsia violet indigo aqua blush mauve plum sage forest hunter camo camouflage bronze copper
champagne royal sky heather oatmeal stone sand espresso offwhite creamwhite hotpink lightblue darkblue navyblue forestgreen
neon multicolor multicolour rainbow""".split())
MATERIALS = tuple("""cotton polyester nylon leather wool spandex silk rayon linen denim suede canvas fleece cashmere fabric
viscose modal acrylic elastane lycra chiffon satin velvet corduroy tweed knit knitted mesh lace rubber synthetic bamboo hemp
down microfiber microfibre jersey flannel twill poplin organza sequin sequins faux fauxleather vegan neoprene goretex
cottonblend polyblend""".split())
SIZES = tuple("small medium large plus plussize onesize osfa petite tall wide narrow".split())
STYLES = tuple("""casual formal vintage athletic sporty business elegant boho streetwear classic modern minimalist preppy
retro cute sexy edgy lounge smart""".split())
FITS = tuple("""slim skinny relaxed regular oversized loose fitted cropped straight bootcut tapered wideleg boyfriend mom
athletic""".split())
FEATURES = tuple("""floral striped stripe plaid checked graphic logo solid printed print sequin lace mesh ripped distressed
waterproof insulated breathable stretch lined""".split())
USES = tuple("""gym workout training hiking yoga swimming beach wedding office work sleep party travel school running walking
cycling tennis golf ski snow rain everyday weekend""".split())
MEN = tuple("male man men mens masculine him his boyfriend husband guy guys dude gentlemen gents menswear gentleman".split())
WOMEN = tuple("female woman women womens ladies lady feminine her hers girlfriend wife gal gals womenswear misses".split())
MEN_PHRASES = ("for him", "for men", "for guys", "mens wear")
WOMEN_PHRASES = ("for her", "for women", "for ladies", "womens wear")
MEN_INDEX, WOMEN_INDEX = ("men", "man", "mens", "male"), ("women", "woman", "womens", "female")
SIZE_PATTERN = r"^(?:eu|us|uk)?-?[0-9]{1,2}(?:[./][0-9])?$|^(?:xxs|xs|s|m|l|xl|xxl|xxxl|2xl|3xl)$"
DETAIL_KEYS = ("color", "colour", "color name", "size", "sizes", "material", "fabric", "brand", "style", "fit", "department", "gender", "occasion")
#: Words of one product type; any of them stands for all.
TYPE_GROUPS = (
    ("shirt", "shirts", "t-shirt", "t-shirts", "tee", "tees", "tshirt"),
    ("polo", "polos"),
    ("blouse", "blouses", "blouses button-down shirts", "tunic", "tunics"),
    ("button-down", "buttondown", "oxford", "casual button-down shirts"),
    ("hoodie", "hoodies", "sweatshirt", "sweatshirts", "fashion hoodies sweatshirts", "pullover", "pullovers"),
    ("tank", "tanks", "cami", "camis", "tanks camis"),
    ("jean", "jeans"),
    ("pant", "pants", "trousers", "slacks", "chinos"),
    ("short", "shorts", "active shorts"),
    ("skirt", "skirts"),
    ("dress", "dresses"),
    ("legging", "leggings"),
    ("jumpsuit", "jumpsuits", "romper", "rompers", "one-piece", "one-pieces"),
    ("sweater", "sweaters", "jumper", "jumpers", "cardigan", "cardigans"),
    ("jacket", "jackets", "coat", "coats"),
    ("shoe", "shoes"),
    ("sneaker", "sneakers", "trainer", "trainers", "fashion sneakers"),
    ("running", "road running"),
    ("flat", "flats"),
    ("pump", "pumps", "heel", "heels"),
    ("boot", "boots", "bootie", "booties", "ankle bootie"),
    ("sandal", "sandals", "heeled sandals"),
    ("slipper", "slippers"),
    ("loafer", "loafers", "loafers slip-ons"),
    ("clog", "clogs", "mule", "mules", "mules clogs"),
    ("oxfords",),
    ("wedge", "wedges", "platforms wedges"),
    ("flip-flop", "flip-flops", "flipflop", "flipflops"),
    ("slide", "slides"),
    ("watch", "watches", "wrist watches"),
    ("sunglass", "sunglasses", "shades"),
    ("hat", "hats", "cap", "caps"),
    ("beanie", "beanies", "skullies beanies"),
    ("sock", "socks", "athletic socks"),
    ("belt", "belts"),
    ("wallet", "wallets"),
    ("bag", "bags", "purse", "handbag", "handbags"),
    ("tote", "totes"),
    ("backpack", "backpacks"),
    ("crossbody", "crossbody bags"),
    ("necklace", "necklaces"),
    ("pendant", "pendants", "pendant necklaces"),
    ("ring", "rings"),
    ("bra", "bras"),
    ("costume", "costumes"),
    ("pajama", "pajamas", "pyjama", "pyjamas", "robe", "robes", "nightgown"),
)
PHRASE_GROUPS = (
    ("t shirt", ("t-shirt", "t-shirts", "tee", "tees")),
    ("t shirts", ("t-shirt", "t-shirts", "tee", "tees")),
    ("tee shirt", ("t-shirt", "t-shirts", "tee")),
    ("button down", ("casual button-down shirts", "button-down")),
    ("button down shirt", ("casual button-down shirts",)),
    ("running shoes", ("road running", "running", "sneakers", "fashion sneakers")),
    ("running shoe", ("road running", "running", "sneakers")),
    ("gym shoes", ("fashion sneakers", "sneakers", "training")),
    ("wrist watch", ("wrist watches", "watches")),
    ("wrist watches", ("wrist watches", "watches")),
    ("for him", MEN_INDEX),
    ("for her", WOMEN_INDEX),
    ("for men", MEN_INDEX),
    ("for women", WOMEN_INDEX),
    ("sweat shirt", ("sweatshirt", "sweatshirts", "hoodie", "hoodies")),
    ("hood ie", ("hoodie", "hoodies")),
    ("flip flops", ("flip-flops", "sandals")),
    ("high heels", ("pumps", "heels", "heeled sandals")),
    ("sports bra", ("sports bras", "bras")),
    ("everyday bra", ("everyday bras", "bras")),
    ("baseball cap", ("baseball caps", "caps", "hats")),
    ("cross body", ("crossbody", "crossbody bags")),
    ("sleep shirt", ("nightgowns sleepshirts", "pajamas")),
)
DECLINES = ("?", "??", "???", "huh", "huh?", "what", "what?", "what??")
DECLINE_CUES = ("no preference", "don't care", "dont care", "doesn't matter", "doesnt matter", "anything", "either is fine", "no opinion", "skip", "i don't know", "i dont know", "idk", "dunno", "no idea", "not sure", "whatever")
#: Ordered rules of a constraint's class: the class, and a pattern on the lower-cased text.
CONSTRAINT_RULES = (
    ("budget", r"budget|(\$|<=|under)\s*[0-9]"),
    ("material", "cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric"),
    ("color", "color|black|white|blue|red|pink|green"),
    ("size", "size|sizing|width|wide|narrow"),
    ("style", "department|style|fit|sleeve|neck"),
    ("use_case", "hiking|running|gym|winter|outdoor|work"),
)
# End of the fixed values.


def tokens(text: Column) -> Column:
    """White-space separated tokens of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def any_in(array: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(array, lambda t: t.isin(*terms))


def looks_like_size(token: Column) -> Column:
    return F.replace(F.lower(token), F.lit(" "), F.lit("")).rlike(SIZE_PATTERN)


def canonical_gender(text: Column) -> Column:
    """men, women, or null if neither or both are meant."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "'-", "")
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    parts = F.split(plain, r"\s+")
    joined = F.replace(plain, F.lit(" "), F.lit(""))

    def meant(words: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
        out = any_in(parts, words) | joined.isin(*words)
        for p in phrases:
            out = out | padded.contains(f" {p} ")
        return out

    men, women = meant(MEN, MEN_PHRASES), meant(WOMEN, WOMEN_PHRASES)
    return F.when(men & ~women, "men").when(women & ~men, "women")


def department(path: Column, details: Column, title: Column) -> Column:
    """From the category path, then the details, then the title; empty if none tells."""
    return F.coalesce(canonical_gender(F.array_join(path, " ")), canonical_gender(F.element_at(details, "department")), canonical_gender(F.element_at(details, "gender")), canonical_gender(title), F.lit(""))


def guess_attribute(phrase: Column) -> Column:
    """The attribute that a phrase speaks of, by the first class it has a word of."""
    t = tokens(phrase)
    joined = F.translate(F.lower(phrase), " -", "")
    has = lambda *lists: any_in(t, sum(lists, ())) | joined.isin(*sum(lists, ()))
    size = joined.isin(*SIZES) | joined.rlike(SIZE_PATTERN) | F.exists(t, lambda x: x.rlike(SIZE_PATTERN) | x.isin(*SIZES))
    return F.when(canonical_gender(phrase).isNotNull(), "department").when(has(COLORS), "color").when(has(MATERIALS), "material").when(size, "size").when(has(FEATURES), "feature").when(has(USES), "use_case").when(has(FITS, STYLES), "style")


def is_slot_token(phrase: Column) -> Column:
    known = tuple(dict.fromkeys((*COLORS, *MATERIALS, *MEN, *WOMEN, *SIZES, *STYLES, *FITS, *USES, *FEATURES)))
    return (~phrase.contains(" ") & phrase.isin(*known)) | ((phrase != "") & looks_like_size(phrase))


def _alias_map() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for words, index in ((MEN, MEN_INDEX), (WOMEN, WOMEN_INDEX)):
        out |= dict.fromkeys(words, index)
    for group in TYPE_GROUPS:  # types come before genders
        out |= dict.fromkeys(group, group)
    return out


def aliases(token: Column) -> Column:
    """The terms that a token stands for; itself if it has none."""
    table = F.create_map(*[x for k, v in _alias_map().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(table, token), F.array(token))


def expand_terms(phrase: Column) -> Column:
    """Distinct aliases of the tokens, then of known phrases, then the whole, in order of first appearance."""
    n = F.lower(phrase)
    padded = F.concat(F.lit(" "), n, F.lit(" "))
    groups = [F.when(padded.contains(f" {p} "), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for p, v in PHRASE_GROUPS]
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.array(F.flatten(F.transform(tokens(n), aliases)), *groups, F.array(n)))))


def classify_constraint(value: Column) -> Column:
    low = F.lower(value)
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in CONSTRAINT_RULES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("feature")


def price_bucket(price: Column) -> Column:
    return F.when(price < 20, "low").when(price < 50, "mid").when(price.isNotNull(), "high")
