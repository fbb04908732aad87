"""Fixed values that results depend on: language codes and names, model names, word lists."""

from __future__ import annotations

LANGUAGES_WITHOUT_SPACES = ("ja", "zh")

# Language code -> name.
LANGUAGE_NAMES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish", "ru": "russian", "ko": "korean",
    "fr": "french", "ja": "japanese", "pt": "portuguese", "tr": "turkish", "pl": "polish", "ca": "catalan",
    "nl": "dutch", "ar": "arabic", "sv": "swedish", "it": "italian", "id": "indonesian", "hi": "hindi",
    "fi": "finnish", "vi": "vietnamese", "he": "hebrew", "uk": "ukrainian", "el": "greek", "ms": "malay",
    "cs": "czech", "ro": "romanian", "da": "danish", "hu": "hungarian", "ta": "tamil", "no": "norwegian",
    "th": "thai", "ur": "urdu", "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian", "la": "latin",
    "mi": "maori", "ml": "malayalam", "cy": "welsh", "sk": "slovak", "te": "telugu", "fa": "persian",
    "lv": "latvian", "bn": "bengali", "sr": "serbian", "az": "azerbaijani", "sl": "slovenian",
    "kn": "kannada", "et": "estonian", "mk": "macedonian", "br": "breton", "eu": "basque",
    "is": "icelandic", "hy": "armenian", "ne": "nepali", "mn": "mongolian", "bs": "bosnian",
    "kk": "kazakh", "sq": "albanian", "sw": "swahili", "gl": "galician", "mr": "marathi", "pa": "punjabi",
    "si": "sinhala", "km": "khmer", "sn": "shona", "yo": "yoruba", "so": "somali", "af": "afrikaans",
    "oc": "occitan", "ka": "georgian", "be": "belarusian", "tg": "tajik", "sd": "sindhi",
    "gu": "gujarati", "am": "amharic", "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese",
    "ht": "haitian creole", "ps": "pashto", "tk": "turkmen", "nn": "nynorsk", "mt": "maltese",
    "sa": "sanskrit", "lb": "luxembourgish", "my": "myanmar", "bo": "tibetan", "tl": "tagalog",
    "mg": "malagasy", "as": "assamese", "tt": "tatar", "haw": "hawaiian", "ln": "lingala", "ha": "hausa",
    "ba": "bashkir", "jw": "javanese", "su": "sundanese", "yue": "cantonese",
}

# Further language names -> code.
LANGUAGE_ALIASES = {
    "burmese": "my", "valencian": "ca", "flemish": "nl", "haitian": "ht", "letzeburgesch": "lb",
    "pushto": "ps", "panjabi": "pa", "moldavian": "ro", "moldovan": "ro", "sinhalese": "si",
    "castilian": "es",
}

# Language code -> sentence-splitter name; other languages use "english".
SENTENCE_SPLITTERS = {
    "cs": "czech", "da": "danish", "de": "german", "el": "greek", "en": "english", "es": "spanish",
    "et": "estonian", "fi": "finnish", "fr": "french", "it": "italian", "nl": "dutch", "no": "norwegian",
    "pl": "polish", "pt": "portuguese", "sl": "slovene", "sv": "swedish", "tr": "turkish",
    "ml": "malayalam", "ru": "russian",
}
DEFAULT_SENTENCE_SPLITTER = "english"

# Language code -> alignment model of the first table.
PRIMARY_ALIGN_MODELS = {
    "en": "WAV2VEC2_ASR_BASE_960H",
    "fr": "VOXPOPULI_ASR_BASE_10K_FR",
    "de": "VOXPOPULI_ASR_BASE_10K_DE",
    "es": "VOXPOPULI_ASR_BASE_10K_ES",
    "it": "VOXPOPULI_ASR_BASE_10K_IT",
}

# Language code -> alignment model of the second table.
SECONDARY_ALIGN_MODELS = {
    "ja": "jonatasgrosman/wav2vec2-large-xlsr-53-japanese",
    "zh": "jonatasgrosman/wav2vec2-large-xlsr-53-chinese-zh-cn",
    "nl": "jonatasgrosman/wav2vec2-large-xlsr-53-dutch",
    "uk": "Yehor/wav2vec2-xls-r-300m-uk-with-small-lm",
    "pt": "jonatasgrosman/wav2vec2-large-xlsr-53-portuguese",
    "ar": "jonatasgrosman/wav2vec2-large-xlsr-53-arabic",
    "cs": "comodoro/wav2vec2-xls-r-300m-cs-250",
    "ru": "jonatasgrosman/wav2vec2-large-xlsr-53-russian",
    "pl": "jonatasgrosman/wav2vec2-large-xlsr-53-polish",
    "hu": "jonatasgrosman/wav2vec2-large-xlsr-53-hungarian",
    "fi": "jonatasgrosman/wav2vec2-large-xlsr-53-finnish",
    "fa": "jonatasgrosman/wav2vec2-large-xlsr-53-persian",
    "el": "jonatasgrosman/wav2vec2-large-xlsr-53-greek",
    "tr": "mpoyraz/wav2vec2-xls-r-300m-cv7-turkish",
    "da": "saattrupdan/wav2vec2-xls-r-300m-ftspeech",
    "he": "imvladikon/wav2vec2-xls-r-300m-hebrew",
    "vi": "nguyenvulebinh/wav2vec2-base-vi-vlsp2020",
    "ko": "kresnik/wav2vec2-large-xlsr-korean",
    "ur": "kingabzpro/wav2vec2-large-xls-r-300m-Urdu",
    "te": "anuragshas/wav2vec2-large-xlsr-53-telugu",
    "hi": "theainerd/Wav2Vec2-large-xlsr-hindi",
    "ca": "softcatala/wav2vec2-large-xlsr-catala",
    "ml": "gvs/wav2vec2-large-xlsr-malayalam",
    "no": "NbAiLab/nb-wav2vec2-1b-bokmaal-v2",
    "nn": "NbAiLab/nb-wav2vec2-1b-nynorsk",
    "sk": "comodoro/wav2vec2-xls-r-300m-sk-cv8",
    "sl": "anton-l/wav2vec2-large-xlsr-53-slovenian",
    "hr": "classla/wav2vec2-xls-r-parlaspeech-hr",
    "ro": "gigant/romanian-wav2vec2",
    "eu": "stefan-it/wav2vec2-large-xlsr-53-basque",
    "gl": "ifrz/wav2vec2-large-xlsr-galician",
    "ka": "xsway/wav2vec2-large-xlsr-georgian",
    "lv": "jimregan/wav2vec2-large-xlsr-latvian-cv",
    "tl": "Khalsuu/filipino-wav2vec2-l-xls-r-300m-official",
    "sv": "KBLab/wav2vec2-large-voxrex-swedish",
    "id": "cahya/wav2vec2-large-xlsr-indonesian",
}

# Languages whose subtitle lines are shorter.
COMPLEX_SCRIPT_LANGUAGES = (
    "th", "lo", "my", "km", "am", "ko", "ja", "zh", "ti", "ta", "te", "kn", "ml", "hi", "ne", "mr", "ar",
    "fa", "ur", "ka",
)

# Comma sign of languages that do not use ",".
COMMAS = {"ja": "、", "zh": "，", "fa": "،", "ur": "،"}
DEFAULT_COMMA = ","

# Conjunctions before which a subtitle may be cut, a list for each language that has one. The subtitle
# operators take other lists as a parameter.
CONJUNCTIONS = {
    "en": (
        "and", "whether", "or", "as", "but", "so", "for", "nor", "which", "yet", "although", "since",
        "unless", "when", "while", "because", "if", "how", "that", "than", "who", "where", "what", "near",
        "before", "after", "across", "through", "until", "once", "whereas", "even", "both", "either",
        "neither", "though",
    ),
    "fr": (
        "et", "ou", "mais", "parce", "bien", "pendant", "quand", "où", "comme", "si", "que", "avant",
        "après", "aussitôt", "jusqu’à", "à", "malgré", "donc", "tant", "puisque", "ni", "soit", "encore",
        "dès", "lorsque",
    ),
    "de": (
        "und", "oder", "aber", "weil", "obwohl", "während", "wenn", "wo", "wie", "dass", "bevor",
        "nachdem", "sobald", "bis", "außer", "trotzdem", "also", "sowie", "indem", "weder", "sowohl",
        "zwar", "jedoch",
    ),
    "es": (
        "y", "o", "pero", "porque", "aunque", "sin", "mientras", "cuando", "donde", "como", "si", "que",
        "antes", "después", "tan", "hasta", "a", "por", "ya", "ni", "sino",
    ),
    "it": (
        "e", "o", "ma", "perché", "anche", "mentre", "quando", "dove", "come", "se", "che", "prima", "dopo",
        "appena", "fino", "a", "nonostante", "quindi", "poiché", "né", "ossia", "cioè",
    ),
    "ja": (
        "そして", "または", "しかし", "なぜなら", "もし", "それとも", "だから", "それに", "なのに", "そのため", "かつ", "それゆえに", "ならば", "もしくは",
        "ため",
    ),
    "zh": (
        "和", "或", "但是", "因为", "任何", "也", "虽然", "而且", "所以", "如果", "除非", "尽管", "既然", "即使", "只要", "直到", "然后", "因此",
        "不但", "而是", "不过",
    ),
    "nl": (
        "en", "of", "maar", "omdat", "hoewel", "terwijl", "wanneer", "waar", "zoals", "als", "dat", "voordat",
        "nadat", "zodra", "totdat", "tenzij", "ondanks", "dus", "zowel", "noch", "echter", "toch",
    ),
    "uk": (
        "та", "або", "але", "тому", "хоча", "поки", "бо", "коли", "де", "як", "якщо", "що", "перш", "після",
        "доки", "незважаючи", "ані",
    ),
    "pt": (
        "e", "ou", "mas", "porque", "embora", "enquanto", "quando", "onde", "como", "se", "que", "antes",
        "depois", "assim", "até", "a", "apesar", "portanto", "já", "pois", "nem", "senão",
    ),
    "ar": (
        "و", "أو", "لكن", "لأن", "مع", "بينما", "عندما", "حيث", "كما", "إذا", "الذي", "قبل", "بعد", "فور", "حتى",
        "إلا", "رغم", "لذلك", "بما",
    ),
    "cs": (
        "a", "nebo", "ale", "protože", "ačkoli", "zatímco", "když", "kde", "jako", "pokud", "že", "než", "poté",
        "jakmile", "dokud", "pokud ne", "navzdory", "tak", "stejně", "ani", "tudíž",
    ),
    "ru": (
        "и", "или", "но", "потому", "хотя", "пока", "когда", "где", "как", "если", "что", "перед", "после",
        "несмотря", "таким", "также", "ни", "зато",
    ),
    "pl": (
        "i", "lub", "ale", "ponieważ", "chociaż", "podczas", "kiedy", "gdzie", "jak", "jeśli", "że", "zanim",
        "po", "jak tylko", "dopóki", "chyba", "pomimo", "więc", "tak", "ani", "czyli",
    ),
    "hu": (
        "és", "vagy", "de", "mert", "habár", "míg", "amikor", "ahol", "ahogy", "ha", "hogy", "mielőtt", "miután",
        "amint", "amíg", "hacsak", "ellenére", "tehát", "úgy", "sem", "vagyis",
    ),
    "fi": (
        "ja", "tai", "mutta", "koska", "vaikka", "kun", "missä", "kuten", "jos", "että", "ennen", "sen jälkeen",
        "heti", "kunnes", "ellei", "huolimatta", "siis", "sekä", "eikä", "vaan",
    ),
    "fa": (
        "و", "یا", "اما", "چون", "اگرچه", "در حالی", "وقتی", "کجا", "چگونه", "اگر", "که", "قبل", "پس", "به محض",
        "تا زمانی", "مگر", "با وجود", "همچنین", "نه",
    ),
    "el": (
        "και", "ή", "αλλά", "επειδή", "αν", "ενώ", "όταν", "όπου", "όπως", "που", "προτού", "αφού", "μόλις",
        "μέχρι", "εκτός", "παρά", "έτσι", "ούτε", "δηλαδή",
    ),
    "tr": (
        "ve", "veya", "ama", "çünkü", "her ne", "iken", "nerede", "nasıl", "eğer", "ki", "önce", "sonra",
        "hemen", "kadar", "rağmen", "hem", "ne", "yani",
    ),
    "da": (
        "og", "eller", "men", "fordi", "selvom", "mens", "når", "hvor", "som", "hvis", "at", "før", "efter",
        "indtil", "medmindre", "således", "ligesom", "hverken", "altså",
    ),
    "he": (
        "ו", "או", "אבל", "כי", "אף", "בזמן", "כאשר", "היכן", "כיצד", "אם", "ש", "לפני", "אחרי", "ברגע", "עד",
        "אלא", "למרות", "לכן", "כמו", "לא", "אז",
    ),
    "vi": (
        "và", "hoặc", "nhưng", "bởi", "mặc", "trong", "khi", "ở", "như", "nếu", "rằng", "trước", "sau", "ngay",
        "cho", "trừ", "vì", "giống", "cũng", "tức",
    ),
    "ko": (
        "그리고", "또는", "그런데", "그래도", "이나", "결국", "마지막으로", "마찬가지로", "반면에", "아니면", "거나", "그럼에도", "그렇기", "때문에",
        "덧붙이자면", "게다가", "그러나", "고", "그래서", "랑", "한다면", "하지만", "무엇", "왜냐하면", "비록", "동안", "언제", "어디서", "어떻게", "만약",
        "그", "전에", "후에", "즉시", "까지", "아니라면", "불구하고", "따라서", "같은", "도",
    ),
    "ur": (
        "اور", "یا", "مگر", "کیونکہ", "اگرچہ", "جبکہ", "جب", "کہاں", "کس طرح", "اگر", "کہ", "سے پہلے", "کے بعد",
        "جیسے ہی", "تک", "اگر نہیں تو", "کے باوجود", "اس لئے", "جیسے", "نہ",
    ),
    "hi": (
        "और", "या", "पर", "तो", "न", "फिर", "हालांकि", "चूंकि", "अगर", "कैसे", "वह", "से", "जो", "जहां", "क्या",
        "नजदीक", "पहले", "बाद", "के", "पार", "माध्यम", "तक", "एक", "जबकि", "यहां", "दोनों",
    ),
}

# Abbreviations whose full stop does not end a sentence (own list).
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "etc", "No", "Nr", "Sr", "Sra", "Mme", "bzw")

# Steps of a two-phase diarization run and the percent range each covers.
PROGRESS_STEPS = {"segmentation": (0.0, 50.0), "embeddings": (50.0, 99.0)}
DEFAULT_PROGRESS_RANGE = (0.0, 99.0)
