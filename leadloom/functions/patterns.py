"""Patterns and word lists that results depend on, as Java regular expressions."""

# Hosts that are not a business's own site: networks, link pages, directories, marketplaces, booking hosts.
NOT_OWN = (
    r"(^|\.)("
    r"vk\.com|vk\.ru|vk\.link|ok\.ru|instagram\.com|facebook\.com|fb\.com|fb\.me|m\.me|messenger\.com|linkedin\.com|"
    r"twitter\.com|x\.com|t\.me|telegram\.me|wa\.me|whatsapp\.com|api\.whatsapp\.com|youtube\.com|youtu\.be|tiktok\.com|"
    r"pinterest\.[a-z.]+|threads\.net|snapchat\.com|"
    r"taplink\.(cc|ws|at)|linktr\.ee|linktree\.com|beacons\.ai|bio\.link|mssg\.me|hipolink\.[a-z]+|lnk\.bio|"
    r"avito\.ru|profi\.ru|yandex\.[a-z]+|2gis\.[a-z]+|zoon\.ru|yell\.ru|flamp\.ru|hh\.ru|ozon\.ru|wildberries\.ru|rutube\.ru|dzen\.ru|"
    r"dikidi\.(net|ru)|yclients\.com|max\.ru|"
    r"google\.[a-z.]+|goo\.gl|g\.page|business\.site|sites\.google\.com|maps\.app\.goo\.gl|"
    r"yelp\.[a-z.]+|tripadvisor\.[a-z.]+|booking\.com|airbnb\.[a-z.]+|thefork\.[a-z.]+|opentable\.[a-z.]+|"
    r"treatwell\.[a-z.]+|fresha\.com|booksy\.com|doctolib\.[a-z]+|zocdoc\.com|trustpilot\.com|"
    r"etsy\.com|amazon\.[a-z.]+|ebay\.[a-z.]+|clients\.site|bit\.ly|tinyurl\.com"
    r")$"
)

# Applicant-tracking systems and how their board links name the company; the token is group 1.
JOB_BOARDS = [
    ("greenhouse", r"https?://(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([\w-]+)"),
    ("lever", r"https?://jobs\.(?:eu\.)?lever\.co/([\w-]+)"),
    ("ashby", r"https?://jobs\.ashbyhq\.com/([\w.-]+)"),
    ("workable", r"https?://apply\.workable\.com/([\w-]+)"),
    ("recruitee", r"https?://([\w-]+)\.recruitee\.com"),
    ("personio", r"https?://([\w-]+)\.jobs\.personio\.(?:de|com)"),
    ("bamboohr", r"https?://([\w-]+)\.bamboohr\.com/(?:careers|jobs)"),
]
JOB_BOARD_STOP = ["embed", "js", "api", "www"]

SOCIAL = {
    "linkedin": r"https?://([a-z]{2,3}\.)?linkedin\.com/(company|in|school)/[^/?#\s\"'<>]+",
    "facebook": r"https?://(www\.|m\.)?(facebook|fb)\.com/(?!sharer|share|plugins|dialog|tr\b|2008)[^?#\s\"'<>]+",
    "instagram": r"https?://(www\.)?instagram\.com/(?!p/|explore|accounts)[^/?#\s\"'<>]+",
    "x": r"https?://(www\.)?(twitter|x)\.com/(?!intent|share|home|search)[A-Za-z0-9_]{1,15}",
    "youtube": r"https?://(www\.)?youtube\.com/(@|c/|channel/|user/)[^?#\s\"'<>]+",
    "tiktok": r"https?://(www\.)?tiktok\.com/@[^/?#\s\"'<>]+",
    "telegram": r"https?://(t\.me|telegram\.me)/(?!share|joinchat/?$)[^?#\s\"'<>]+",
    "whatsapp": r"https?://(wa\.me|api\.whatsapp\.com|chat\.whatsapp\.com)/[^#\s\"'<>]*",
    "vk": r"https?://(m\.)?vk\.(com|ru)/(?!share|widget)[^?#\s\"'<>]+",
    "max": r"https?://max\.ru/[^?#\s\"'<>]+",
}
MESSENGERS = ["telegram", "whatsapp", "max"]

EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-zа-я]{2,}"
EMAIL_JUNK = (
    r"\.(png|jpe?g|webp|svg|gif|css|js)$|example\.|sentry|wixpress|@domain\.|@email\.|@sentry|@2x|u003e|noreply|"
    r"no-reply|donotreply|@mysite|@yoursite|@company\.com$|user@|name@|@test\.|\.local$"
)
GENERIC_LOCAL = (
    r"^(info|hello|hi|contact|contacts|office|admin|mail|sales|support|team|enquiries|enquiry|inquiries|booking|bookings|"
    r"reception|kontakt|kontakte|post|general|help|service|marketing|press|media|jobs|careers|hr|billing|accounts|orders|"
    r"shop|store|zakaz|info\d*)$"
)
LEGAL_FORMS = r"\b(ооо|ип|ао|зао|оао|llc|ltd|limited|inc|gmbh|lda|sa|sl|srl|bv|plc|co|corp|company)\b\.?"
QUOTES = "[«»\"'“”„`]"

TIERS = ["A", "B", "C", "D"]

# Product types of orders, tried in this order on lower-case text; intent stands before product.
PRODUCTS = [
    (
        "leadgen_sales",
        r"(поиск|найти|находить|привлеч|привести|приводить)\w* (\w+ )?(клиент|заказчик|лид|покупател)|лидогенер|"
        r"(выплат|оплат|вознагражд)\w* за (\w+ )?(клиент|лид|заказчик)|\b(find|bring)( me)? (new )?(clients|customers)|lead generation",
    ),
    (
        "telegram_bot",
        r"телеграм[- ]?бот|telegram[- ]?бот|бот[а-я]* (в|для) (телеграм|telegram|tg)|\bтг[- ]?бот|чат[- ]?бот|\bбот\b|\bбота\b|mini ?app|"
        r"мини[- ]?апп|telegram bot|chat ?bot|discord bot|whatsapp bot|\bbots?\b",
    ),
    ("parser_scraper", r"парс(ер|инг|ить)|скрап|scrap|сбор (данных|базы|контакт)|выгрузк|crawler|data extraction|\bparser\b|zenno|зенно"),
    (
        "crm_integration",
        r"amo ?crm|амо ?срм|битрикс|bitrix|\bcrm\b|\bсрм\b|интеграц|\bapi\b|вебхук|webhook|\b1с\b|\b1c\b|мойсклад|retailcrm|\bб24\b|\bb24\b|"
        r"телефони[яюи]|hubspot|salesforce|pipedrive|zoho|integrat",
    ),
    ("ai_automation", r"нейросет|\bии\b|\bai\b|gpt|chatgpt|llm|n8n|make\.com|автоматизац|zapier|automat|openai|ai agent"),
    (
        "mobile_app",
        r"мобильн[а-я]* приложен|android|андро[иі]д|\bios\b|айос|flutter|react native|google play|app store|rustore|mobile app|"
        r"приложени[еяю] (для|под)",
    ),
    (
        "marketplace_ecom",
        r"wildberries|\bwb\b|озон|ozon|маркетплейс|интернет[- ]магазин|woocommerce|insales|shopify|карточ[а-я]* товар|amazon|etsy|"
        r"e-?commerce|online store|marketplace",
    ),
    (
        "site_fix",
        r"доработ|исправ|ошибк|баг|почин|перенос сайт|ускор|оптимизац[а-я]* скорост|не работает|правк|\bfix|\bbug|broken|not working|"
        r"speed up|migrat",
    ),
    (
        "web_app",
        r"личн[а-я]* кабинет|\bphp\b|laravel|django|\breact\b|\bvue\b|javascript|фронт[- ]?энд|бэк[- ]?энд|frontend|front-end|backend|"
        r"веб[- ]?(приложен|сервис)|web ?app|\bsaas\b|dashboard|admin panel|админк",
    ),
    (
        "landing_site",
        r"лендинг|landing|сайт|tilda|тильд|wordpress|вордпресс|верстк|верстать|website|web site|webflow|\bwix\b|squarespace|framer",
    ),
    (
        "script_tool",
        r"скрипт|python|питон|программ[а-я]* для|расширени[ея] (для )?(хром|браузер)|chrome extension|excel|google ?(таблиц|sheets)|макрос|"
        r"\bscript|spreadsheet|macro|browser extension",
    ),
    ("game", r"\bигр[аыу]\b|unity|unreal|геймдев|roblox|\bgame\b"),
    (
        "design",
        r"дизайн|логотип|баннер|фигма|figma|иллюстрац|макет|инфографик|обложк|презентац|design|\blogo|banner|illustrat|mockup|presentation",
    ),
    ("video_audio", r"видео|монтаж|ролик|reels|анимац|озвуч|подкаст|трек|video|animation|voice ?over|podcast"),
    (
        "seo_ads",
        r"\bseo\b|сео|продвижен|директ|таргет|реклам|трафик|ссылк|контекст|google ads|facebook ads|meta ads|\bppc\b|traffic|backlink",
    ),
    (
        "smm_content",
        r"smm|контент|ведени[ея]|пост[ыо]в|статьи|копирайт|текст|рерайт|сторис|инстаграм|вконтакт|\bвк\b|дзен|content|copywrit|article|"
        r"blog post|social media",
    ),
    (
        "leadgen_sales",
        r"клиент|лид|продаж|холодн|обзвон|рассылк|менеджер по продаж|поиск заказчик|lead gen|\bleads\b|cold (email|call)|"
        r"appointment setting|\bsales\b",
    ),
]

# Words that say nothing about what is bought.
STOP_WORDS = """и в во не на с со что как для по из от до за к ко о об а но или же ли бы то это все так уже при без
под над про через нужно нужен нужна нужны надо есть будет можно который которые которая чтобы если также только
очень более сделать необходимо требуется задача задачи работа работы проект проекта проекту заказ заказа ищем ищу
делать создать разработка разработать человек каждый оплата формат срочно опыт работать задание нужен нам наш наша
наши мне меня вас вам ваш ваши свой своих один одна одно день дней есть было будет может хочу хотим примерно где
the and for with that this from have need needs are you your our will can into who what want looking help would
should about there their they them been more some any all also just like work project task job using use create
make build please each per day days one new get its it's has was were which when how""".split()
