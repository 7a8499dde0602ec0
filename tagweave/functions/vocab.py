"""Word lists of the tag operators."""

# Results depend on these exact words.

# Words that make a tag an edge case of consolidation wherever they stand.
EDGE_WORDS = (
    "tattoo", "piercing", "headwear", "on", "up", "in", "of", "at", "looking", "viewer", "grabbing", "pubic",
    "apart", "by", "own mouth", "grab", "object insertion", "spread", "milking machine", "clothed", "together",
    "between", "removed", "adjusting", "around", "head wings", "thong", "lift", "while", "caressing", "cutout",
    "torn", "back", "under", "behind", "shibari", "uniform", "tentacle around", "holster", "reverse",
    "pull", "with", "very", "over", "tying", "arm hair", "pulled back", "holding", "drying hair",
    "hair ribbon", "through", "ring", "no", "top", "extra", "platform heels", "out", "peek", "disembodied",
    "one", "across", "hold", "hitachi", "slip", "licking",
)

# Parts of words that do the same.
EDGE_PARTS = ("ale mast", "ari mast")

# Whole tags that are edge cases.
EDGE_TAGS = (
    "facial hair", "navel hair", "armpit hair", "chest hair", "pubic hair", "ass visible through thighs",
    "feet out of frame", "head out of frame", "leg lift", "thigh high", "closed eyes", "glowing eyes",
    "half-closed eyes", "rolling eyes", "tail ornament", "open mouth", "closed mouth", "thighhighs under boots",
    "high heel", "ball bra", "huge ass", "perky breasts", "playing with own hair", "crying with eyes open",
    "hair bow", "dress shirt", "hair scrunchie", "off shoulder", "thighband pantyhose", "short shorts",
    "open jacket", "short sleeves", "wide sleeves", "low wings", "detached wings", "covered eyes",
    "doughnut hair bun", "covered nipples", "covered mouth", "torn clothes", "revealing clothes",
    "clothes in mouth", "shirt in mouth", "m legs", "arm grab", "legs up", "puckered lips",
    "footwear bow", "platform footwear", "hand paper fan", "stuffed toy", "colored inner hair", "thigh boots",
    "single hair bun", "double bun", "strap slip", "bags under eyes", "hair flower", "hair between eyes",
    "furry female", "furry male", "faceless male", "faceless female", "muscular female", "muscular male",
    "rei no himo", "cone hair bun", "crop top", "big hair", "upper teeth only", "lower teeth only",
)

ANIMAL_EARS = (
    "alpaca ears", "bat ears", "bear ears", "beaver ears", "bird ears", "boar ears", "cat ears", "cow ears",
    "deer ears", "dog ears", "fake animal ears", "ferret ears", "fox ears", "gazelle ears", "giraffe ears",
    "goat ears", "hamster ears", "hippopotamus ears", "horse ears", "jackal ears", "jaguar ears", "leopard ears",
    "lion ears", "monkey ears", "moose ears", "mouse ears", "otter ears", "panda ears", "pig ears",
    "rabbit ears", "raccoon ears", "rhinoceros ears", "sheep ears", "squirrel ears", "tamandua ears",
    "tapir ears", "tiger ears", "weasel ears", "wolf ears", "zebra ears", "animal ears",
)
BREAST_SIZES = ("small breasts", "medium breasts", "large breasts", "huge breasts", "gigantic breasts", "flat chest")
SCLERA_COLORS = (
    "aqua sclera", "black sclera", "blue sclera", "brown sclera", "green sclera", "grey sclera",
    "orange sclera", "pink sclera", "purple sclera", "red sclera", "yellow sclera",
)
HAIR_LENGTHS = ("short hair", "very long hair", "medium hair", "absurdly long hair", "very short hair", "long hair")
HAIR_COLORS = (
    "blonde hair", "blond hair", "brown hair", "black hair", "blue hair", "pink hair", "purple hair",
    "white hair", "grey hair", "gray hair", "red hair", "green hair", "orange hair", "aqua hair",
)
EYE_COLORS = (
    "brown eyes", "black eyes", "blue eyes", "pink eyes", "purple eyes", "white eyes",
    "grey eyes", "gray eyes", "red eyes", "green eyes", "orange eyes", "aqua eyes", "yellow eyes",
)
LIP_COLORS = (
    "aqua lips", "black lips", "blue lips", "brown lips", "gold lips", "green lips", "grey lips",
    "purple lips", "orange lips", "pink lips", "red lips", "silver lips", "white lips", "yellow lips",
)
GENITALIA_SIZES = ("small pen", "medium pen", "large pen", "huge pen", "gigantic pen")
TESTICLE_SIZES = ("small testic", "medium testic", "large testic", "huge testic", "gigantic testic")
GENITALIA_STATES = ("flaccid", "erection")
SKIN_COLORS = (
    "black skin", "blue skin", "pink skin", "purple skin", "white skin", "grey skin",
    "gray skin", "red skin", "green skin", "orange skin", "yellow skin",
)
CLOTHING_ASIDE = (
    "clothing aside", "panties aside", "bikini bottom aside", "leotard aside", "swimsuit aside",
    "buruma aside", "thong aside", "shorts aside", "fundoshi aside", "pelvic curtain aside",
    "dress aside", "skirt aside", "apron aside", "bodysuit aside",
)
CLOTHING_PULL = (
    "clothes pull", "shirt pull", "dress pull", "skirt pull", "shorts pull", "pants pull",
    "one-piece swimsuit pull", "bikini pull", "bra pull", "pantyhose pull", "sports bra pull",
)
CLOTHING_LIFT = (
    "clothes lift", "bikini top lift", "dress lift", "hakama lift", "hoodie lift", "kimono lift",
    "pelvic curtain lift", "sarong lift", "shirt lift", "skirt lift", "sports bra lift",
    "sweater lift", "swimsuit lift", "towel lift", "bikini lift",
)

# Tags that redundancy removal always drops.
STOP_TAGS = ("questionable", "explicit", "sensitive", "censored", "uncensored", "solo", "general", "meme", "meme attire", "mosaic censoring")

# Categories that hold one value, in the order in which they are tried: (name, words, case-sensitive parts that
# rule it out, tags whose presence lets the category hold several values).
CATEGORIES = (
    ("breast_size", BREAST_SIZES, (), ()),
    ("genitalia_size", GENITALIA_SIZES, (), ()),
    ("testicle_size", TESTICLE_SIZES, (), ()),
    ("genitalia_state", GENITALIA_STATES, (), ()),
    ("hair_length", HAIR_LENGTHS, (), ()),
    ("hair_color", HAIR_COLORS, ("hairband",), ("two-tone hair", "multicolored hair")),
    ("eye_color", EYE_COLORS, ("eyeshadow",), ()),
    ("skin_color", SKIN_COLORS, (), ()),
    ("lip_color", LIP_COLORS, (), ("multicolored lips",)),
    ("sclera_color", SCLERA_COLORS, (), ("mismatched sclera",)),
    ("animal_ears", ANIMAL_EARS, (), ()),
    ("clothing_aside", CLOTHING_ASIDE, (), ()),
    ("clothing_lift", CLOTHING_LIFT, (), ()),
    ("clothing_pull", CLOTHING_PULL, (), ()),
    ("eyewear", None, (), ()),  # case-sensitive part "eyewear"
)
