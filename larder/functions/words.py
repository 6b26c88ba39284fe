"""Word lists, tables and coefficients that results depend on."""

# Swap scoring.
OVERLAP_STOP_WORDS = ["and", "the", "with", "organic", "raw", "fried", "without", "fat", "pan", "in", "of", "for", "a"]
SMART_STOP_WORDS = ["and", "with", "fresh", "organic", "raw", "roasted", "the", "a", "in", "of", "for"]
VECTOR_STOP_WORDS = ["and", "the", "with", "organic", "raw", "fried", "without", "fat", "pan", "for", "min"]
UNSWEETENED = ["zero", "diet", "plain", "unsweetened", "no sugar"]
SWEETENED = ["sweet", "sugar", "syrup", "honey", "sweetened", "chocolate", "candy", "pastry", "cola", "cookie", "cake"]
SMART_SWEETENED = ["sweetened", "classic", "sugar", "syrup"]
SMART_UNSWEETENED = ["zero", "diet", "unsweetened", "sugar-free", "sugar free", "no sugar"]
SMART_RESTRICTED = ["beer", "wine", "vodka", "alcohol", "liquor", "spirit"]
LIQUID = ["drink", "juice", "beverage", "milk", "soda", "water", "cola", "liquid", "tea", "coffee", "stock", "broth", "cream", "sahne"]
SMART_LIQUID = ["drink", "beverage", "water", "milk", "juice", "soda", "cola", "tea", "coffee"]
RESTRICTED = ["alcohol", "beer", "wine", "energy drink", "liquor", "vodka", "rum", "whiskey", "spirit"]
RAW_INGREDIENT = ["flour", "starch", "dried", "powder"]
STRICT_GROUPS = ["VEG", "FRUIT", "GRAINS", "SWEETS", "SNACKS"]

# Equivalence groups, in order: category words, name words.
GROUPS = [
    ("OILS_FATS", ["oil", "fat"], ["oil"]),
    ("MEAT_ALT", ["meat", "poultry"], ["mince", "sausage"]),
    ("DAIRY_ALT", ["milk", "dairy", "cheese", "yoghurt"], ["yoghurt", "cheese", "milk"]),
    ("GRAINS", ["cereal", "bread", "pasta", "rice", "grain"], []),
    ("VEG", ["vegetable"], ["vegetable"]),
    ("FRUIT", ["fruit"], []),
    ("SWEETS", ["sweet", "sugar", "chocolate"], []),
    ("BEVERAGES", ["beverage", "drink", "juice"], []),
]

# Culinary roles, in order, and the categories that rule some of them out.
ROLES = [
    ("FAT", ["oil", "butter", "margarine", "lard", "shortening"]),
    ("SWEETENER", ["sugar", "honey", "syrup", "sweetener", "agave"]),
    ("CHEMICAL_LEAVENING", ["baking powder", "baking soda", "bicarbonate"]),
    ("YEAST", ["yeast"]),
    ("EGG", ["egg"]),
    ("DAIRY_LIQUID", ["milk", "cream", "buttermilk"]),
    ("FLOUR_STARCH", ["flour", "starch", "cornflour", "cornstarch"]),
    ("PROTEIN", ["chicken", "beef", "pork", "turkey", "fish", "salmon", "tuna", "tofu", "lentil", "bean", "mince", "sausage"]),
    ("SEASONING", ["salt", "pepper", "spice", "herb", "seasoning", "vanilla", "cinnamon"]),
]
ROLE_EXCLUDED = ["Vegetables", "Fruit", "Soups and stocks", "Prepared dishes", "Potatoes and starches"]
COARSE_ROLES = ["VEGETABLE", "FRUIT", "OTHER"]

# Ranker: feature, mean, scale, weight.
RANKER = [
    ("cosine_sim", 0.900981, 0.048455, 0.0127),
    ("same_swiss_category", 0.606481, 0.488530, 1.1753),
    ("liquid_mismatch", 0.185185, 0.388448, -0.6130),
    ("raw_ingredient_mismatch", 0.064815, 0.246199, -0.5563),
    ("delta_kcal", -7.388889, 170.331693, 0.3884),
    ("delta_sugar_g", -0.277315, 15.280673, -0.3948),
    ("delta_fat_g", -1.253704, 16.712775, -0.2681),
    ("delta_satfat_g", 0.142130, 9.896176, -0.0711),
    ("delta_protein_g", 1.648148, 7.108419, -0.1188),
]
RANKER_INTERCEPT = -0.7826

# Grams of one unit, and the units in the order in which they are tried.
UNIT_GRAMS = {"tbsp": 15, "tablespoon": 15, "tsp": 5, "teaspoon": 5, "cup": 240, "ml": 1, "l": 1000, "kg": 1000, "g": 1, "gram": 1, "oz": 28.35, "ounce": 28.35, "lb": 453.6, "pound": 453.6, "egg": 55, "onion": 110, "clove": 5, "slice": 30, "handful": 30, "bunch": 50, "pinch": 1, "can": 400, "jar": 300}
UNIT_PATTERN = r"tbsp|tablespoon|tsp|teaspoon|cup|ml|l\b|kg|g\b|gram|oz|ounce|lb|pound|egg|onion|clove|slice|handful|bunch|pinch|can|jar"
FRACTIONS = [("½", "0.5"), ("¼", "0.25"), ("¾", "0.75"), ("⅓", "0.333"), ("⅔", "0.667")]

# Receipt lines.
META_TOKENS = ["pfand", "leergut", "summe", "total", "mwst", "steuer", "rabatt", "coupon", "aktions", "gutschein", "rueckgeld", "visa", "mastercard", "maestro", "girocard", "ec-karte", "gegeben", "rueck", "kasse", "bediener", "nr", "datum", "uhrzeit", "artikel", "netto", "brutto", "eur", "euro", "kartenzahlung", "barzahlung", "zahlen", "kreditkarte", "kontaktlos", "kundenbeleg", "kunden", "beleg", "geg", "bezahlung", "contactless"]
LINE_UNITS = ["st", "stk", "pck", "pkg", "btl", "lose", "vke", "sort", "ca", "ab", "pk"]
LEGAL_ENTITIES = ["ohg", "ohb", "gmbh", "inhaber", "ust", "uid"]
STORES = ["rewe", "aldi", "lidl", "edeka", "kaufland", "netto", "penny"]
ADDRESS_WORDS = ["allee", "strasse", "straße", "platz", "weg", "gasse", "damm", "ring", "ufer"]

# Matching.
HEAD_NOUNS = ["brot", "broetchen", "wurst", "kaese", "milch", "saft", "sahne", "creme", "oel", "öl", "schinken", "salat", "suppe", "pudding", "paprika", "joghurt", "fleisch", "tee", "wasser", "wein", "bier", "pizza", "reis", "baguette", "baguett", "mais", "quark", "nudeln", "butter", "beutel", "tuete", "netz", "salami", "koerner", "gemuese"]
CORE_NOUN_PATTERN = "joghurt|yogurt|milch|milk|kaese|cheese|brot|bread|pudding|flammkuchen|griess|granatapfel|apfel|apple|banane|banana|tomate|tomato|zwiebel|onion|kartoffel|potato|zitrone|lemon|salami|schinken|ham|wurst|sausage|nuss|nuesse|nut|peanut|erdnuss|reis|rice|fisch|fish|fleisch|meat|eier|egg|birne|pear|traube|grape|gurke|cucumber|mozzarella|gouda|parmesan|ricotta|feta|camembert|edamer|pesto|gnocchi|tortelloni|quark|butter|teigwaren|chili|paprika|skyr|baguette|baguett|roggen|ravioli|salat|pfeffer|pizza|sahne|rahm|creme|haehnchen|hähnchen|huhn|chicken|pute|truthahn|ente|gefluegel|geflügel"
DESCRIPTORS = ["sort", "sortiert", "lose", "natur", "classic", "clas", "fein", "extra", "spezial", "surt", "frisch", "hausgemacht", "regional", "leicht", "light", "mix", "protein", "steinofen", "ofenfrisch", "pur", "marken", "pikant", "toskana", "toscana", "provence", "griechischer", "griechische", "beutel", "tuete", "netz", "weiss", "wei", "weisse"]
IMPLICIT_QUALIFIERS = ["roh", "raw", "natur", "plain", "frisch", "fresh", "min", "mind", "fat", "fett", "dry", "matter", "schwein", "rind", "pute", "kalb", "haehnchen", "huhn", "lamm", "pork", "beef", "veal", "kochpoekelware", "poekelware", "konserve", "dose", "dosenschinken", "cured", "canned", "geroestet", "roasted", "gesalzen", "salted", "getrocknet", "dried"]
PLANT_WORDS = ["vegan", "soja", "pflanzlich", "vegetarisch", "alternative", "tofu"]
DIET_WORDS = ["glutenfrei", "glutenfree", "laktosefrei", "lactosefree", "zuckerfrei", "sugarfree"]
COMPOSITE_WORDS = ["gefüllt", "mit", "dessert", "sauce", "aromatisiert"]
PROCESSED_SUFFIXES = ["mus", "mark", "saft", "öl", "oel", "creme", "brei"]
CONFUSIONS = {"t": "nil", "i": "nlt", "l": "it", "n": "mtiuw", "m": "n", "o": "0eu", "u": "nvo", "v": "u", "f": "t", "c": "eo", "e": "cos", "r": "n", "d": "gb", "g": "d", "s": "e", "q": "o", "w": "n", "b": "d"}
DROPPED_BRANDS = ["gran", "grandiso", "grop", "m.i.", "m.i", "mi", "bistro", "ostmann"]
CERTIFICATIONS = ["ogt", "vlog", "bio"]
SPLIT_PREFIXES = ["protein", "schoko", "bistro", "mini", "bio", "vegan", "veggie"]
DESSERT_WORDS = ["pudding", "dessert", "joghurt", "jogh", "pu", "pu."]
ABBREVIATIONS = {"jogh": "joghurt", "sort": "sortiert", "sort.": "sortiert", "clas": "classic", "clas.": "classic", "pr": "protein", "pu": "pudding", "mozz": "mozzarella", "nozz": "mozzarella", "pfann": "pfannengericht", "sojajogh": "soja joghurt", "sojadr": "soja joghurt drink", "moz": "mozzarella", "skr": "skyr", "himb": "himbeere", "cranb": "cranberry", "pudd": "pudding", "brocc": "brokkoli", "erdbe": "erdbeere", "heidelbe": "heidelbeere", "himbe": "himbeere", "geflueg": "gefluegel", "put": "pute", "gem": "gemischt", "hähn": "hähnchen", "tom": "tomate", "rogg": "roggen", "koff": "koffein", "prot": "protein", "norweg": "norwegisch", "leberw": "leberwurst", "schlagsa": "schlagsahne"}
SYNONYMS = {"fusilli": "teigwaren pasta", "nudeln": "teigwaren pasta", "maccheroni": "teigwaren pasta", "aceto": "essig", "balsamico": "essig balsam", "arrabbiata": "tomatensauce scharf", "arrabiat": "tomatensauce scharf", "penne": "teigwaren pasta", "spaghetti": "teigwaren pasta", "tagliatelle": "teigwaren pasta", "lady": "apfel apple", "braeburn": "apfel apple", "elstar": "apfel apple", "jonagold": "apfel apple", "boskoop": "apfel apple", "pinova": "apfel apple", "grana": "parmesan hartkaese", "para": "parmesan", "parmigiano": "parmesan", "tomme": "kaese cheese", "blanche": "kaese cheese", "pestu": "pesto", "diavolo": "pizza scharfe salami", "reggiano": "parmesan hartkaese", "ravioli": "teigwaren pasta", "angus": "rind beef", "pfefferkoer": "pfefferkoerner pfeffer", "suppengemuese": "suppengruen gemuese", "innenfilet": "filet brustfilet"}

# Profiles.
ACTIVITY = {"Sedentary": 1.2, "Lightly Active": 1.375, "Moderately Active": 1.55, "Very Active": 1.725, "Extra Active": 1.9}
GOAL_KCAL = {"-0.5 kg": -500, "-0.25 kg": -250, "stay": 0, "+0.25 kg": 250, "+0.5 kg": 500}

# Micronutrient targets: name, female amount, male amount.
MICRO_TARGETS = [("vitamin_a_ug", 700.0, 900.0), ("betacarotene_ug", 4800.0, 4800.0), ("vitamin_b1_mg", 1.1, 1.2), ("vitamin_b2_mg", 1.1, 1.3), ("vitamin_b6_mg", 1.3, 1.3), ("vitamin_b12_ug", 2.4, 2.4), ("niacin_mg", 14.0, 16.0), ("folate_ug", 400.0, 400.0), ("pantothenic_acid_mg", 5.0, 5.0), ("vitamin_c_mg", 75.0, 90.0), ("vitamin_d_ug", 15.0, 15.0), ("vitamin_e_mg", 15.0, 15.0), ("sodium_mg", 1500.0, 1500.0), ("potassium_mg", 2600.0, 3400.0), ("chloride_mg", 2300.0, 2300.0), ("calcium_mg", 1000.0, 1000.0), ("magnesium_mg", 310.0, 400.0), ("phosphorus_mg", 700.0, 700.0), ("iron_mg", 18.0, 8.0), ("iodide_ug", 150.0, 150.0), ("zinc_mg", 8.0, 11.0)]

# Sites that have a name of their own.
SITES = {"bbc.co.uk": "BBC Good Food", "bbcgoodfood.com": "BBC Good Food", "allrecipes.com": "Allrecipes", "food.com": "Food.com", "epicurious.com": "Epicurious", "foodnetwork.com": "Food Network", "bonappetit.com": "Bon Appétit", "seriouseats.com": "Serious Eats", "delish.com": "Delish", "simplyrecipes.com": "Simply Recipes", "tasty.co": "Tasty", "recipetineats.com": "RecipeTin Eats", "jamieoliver.com": "Jamie Oliver", "nigella.com": "Nigella", "hellofresh.com": "Hello Fresh", "chefkoch.de": "Chefkoch"}

# Category icons, in order.
ICONS = [("restaurant-outline", ["meat", "sausage", "poultry"]), ("fish-outline", ["fish", "seafood"]), ("egg-outline", ["dairy", "egg", "milk", "cheese"]), ("leaf-outline", ["fruit", "vegetable"]), ("water-outline", ["drink", "beverage", "water"]), ("ice-cream-outline", ["sweet", "pastry", "sugar"]), ("nutrition-outline", ["cereal", "grain", "bread", "pantry"])]

# Patterns of lines that name no product: what they are matched with, the pattern, and whether a price saves the line.
PRICE = r"\d[.,]\d{2}"
POSTCODE = r"^\d{4,5}(?![A-Za-z0-9_])"
LINE_RULES = [
    ("folded", r"[a-z]+strasse(\s+\d+)?$", False),
    ("line", r"^swap: |^scanned: |b swap:", False),
    ("line", r"^-?\d+([.,]\d+)?\s*(kgx|kg|g|x)?$", False),
    ("line", r"^\d+\s*x\s*-?\d+[.,]\d{2}", False),
    ("line", r"(?<![A-Za-z0-9_])eur\s*/\s*kg(?![A-Za-z0-9_])", False),
    ("line", r"^\d+[.,]\d+\s*(kg|g)(?![A-Za-z0-9_])", False),
    ("line", r"^-?\d+[.,]\d{2}\s*[a-c]?$", False),
    ("line", r"www|http|\.de(?![A-Za-z0-9_])|\.com(?![A-Za-z0-9_])|online", False),
    ("line", r"[a-zäöü]+stra(ß|ss)e$", False),
    ("line", r"^\d+\s*stk\.?\s*x?$", False),
    ("line", r"-.*-.*-", True),
]

# Patterns by which lines are rewritten, each with what takes its place, in order.
CASE_STEPS = [("([A-Z]+)([A-Z][a-z])", "$1 $2"), ("([a-z])([A-Z])", "$1 $2")]
NO_WORD_SIGN = r"[^\w\säöüßÄÖÜ]"
EXPANSION_STEPS = [
    (r"[.\-]", " "),
    *((rf"(?i)(?<![A-Za-z0-9_])({prefix})", "$1 ") for prefix in SPLIT_PREFIXES),
    (NO_WORD_SIGN, " "),
    (r"(?i)(?<![A-Za-z0-9_])bio\s*bio(?![A-Za-z0-9_])", "bio"),
]
OVERRIDE_STEPS = [
    (r"(?<![a-z0-9_])\d+[.,]\d{2}(?![a-z0-9_])", " "),
    (r"(?<![a-z0-9_])\d+([.,]\d+)?\s*(mg|kg|g|ml|cl|l)(?![a-z0-9_])", " "),
    (r"(?<![a-z0-9_])\d+\s*(x|st|stk|er)(?![a-z0-9_])", " "),
    (r"\s+[a-c]\s*$", " "),
    (r"[^\p{L}\p{N}]+", " "),
]
# Words with one digit inside, which is dropped; words with digits, which are read as letters; the digits and their letters.
ONE_DIGIT = r"(?iu)^[a-zäöüß]+\d[a-zäöüß]*$"
DIGITS_IN_WORD = r"(?iu)\d[a-zäöüß]+|[a-zäöüß]+\d"
DIGITS, DIGITS_AS_LETTERS = "01568", "olsgb"
FAT = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:%|fat|fett)"
