"""Patterns for landed pages, as Java regular expressions, and fingerprints of technologies."""

INNER_PATH = (
    r"contact|kontakt|contatt|contacto|contato|kontakty|svyaz|about|about-us|o-nas|o-kompan|uber-uns|ueber-uns|chi-siamo|"
    r"quienes|sobre|qui-sommes|a-propos|team|our-team|staff|people|leadership|management|equipe|equipo|"
    r"impressum|imprint|legal|mentions-legales|aviso-legal|note-legali|privacy|datenschutz|politik|konfid|rekvizit|"
    r"location|find-us|visit"
)
INNER_TEXT = (
    r"contact|kontakt|contatt|contacto|contato|about|team|staff|people|impressum|imprint|legal|privacy|"
    r"контакт|о компании|о нас|команда|реквизит|политик"
)
SKIP_PATH = (
    r"/(auth|login|signin|signup|register|cart|basket|checkout|order|account|my-account|wp-admin|feed)\b|"
    r"\.(pdf|docx?|xlsx?|jpe?g|png|gif|webp|svg|zip|mp4)$"
)

INN = r"ИНН[\s:\-№]*(\d{12}|\d{10})(?!\d)"
OGRN = r"ОГРН(?:ИП)?[\s:\-№]*(\d{15}|\d{13})(?!\d)"
UK_NUMBER = r"(?i)(?:company|registration|registered|reg\.?)\s*(?:no\.?|number|num\.?)?\s*[:#]?\s*((?:SC|NI|OC|SO|NC)?\d{6,8})\b"
UK_WORDS = r"england|wales|scotland|companies house|united kingdom|\buk\b"
EU_VAT = (
    r"\b(?:VAT|USt-?IdNr\.?|TVA|IVA|NIF|BTW|MwSt|P\.?\s?IVA)[^A-Z0-9]{0,15}"
    r"((?:AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK|GB|XI)\s?[0-9A-Z]{8,12})\b"
)
DE_REGISTER = r"\b(HR[AB]\s?\d{3,6}(?:\s?[A-Z])?)\b"
DE_WORDS = r"amtsgericht|registergericht|handelsregister"
LEGAL_NAME = (
    r"(?U)(?:(?:ООО|ОАО|АО|ЗАО|ПАО|АНО)\s*[«\"“][^»\"”]{2,60}[»\"”]|(?:ИП|Индивидуальный предприниматель)\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){0,2}|"
    r"\b[A-Z][\w&.,'\- ]{1,60}?\s(?:Ltd|Limited|LLC|L\.L\.C\.|Inc\.?|GmbH|UG|AG|S\.?L\.?|S\.?A\.?|Lda\.?|S\.?r\.?l\.?|B\.?V\.?|SAS|SARL|Sp\. z o\.o\.|Oy|AB|ApS|AS|plc)\b)"
)
BANK = r"банк|\bbank\b|sparkasse|banco|banque"

_ROLES = (
    r"founder|co-?founder|owner|ceo|chief \w+ officer|managing director|director|"
    r"(?:general|practice|office|operations|marketing|sales|clinic|studio) manager|"
    r"head of \w+|partner|principal|president|vp (?:of )?\w+|cto|cmo|coo|cfo|"
    r"gesch[äa]ftsf[üu]hrer|inhaber|propriet[áa]rio|director[a]? general|g[ée]rant|"
    r"генеральный директор|директор|основатель|владелец|руководитель"
)
ROLE = rf"\b({_ROLES})\b"
PERSON = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'\-]{1,20}(?:\s[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'\-]{1,20}){1,2}|[А-ЯЁ][а-яё]{1,20}\s[А-ЯЁ][а-яё]{1,20}(?:\s[А-ЯЁ][а-яё]{1,20})?"
# Words that stand next to names on team pages and are no part of them.
_NOT_NAMES = (
    r"our|the|meet|team|about|contact|practice|office|clinic|studio|manager|dentist|doctor|dr|lead|senior|"
    r"junior|head|chief|officer|principal|associate|assistant|founder|co-founder|owner|partner|director|"
    r"president|staff|services|home|hygienist|nurse|receptionist|specialist|consultant|engineer|designer|"
    r"developer|accountant|lawyer|attorney|solicitor|advisor|coordinator|executive|managing|general|"
    r"operations|marketing|sales|customer|support|of|and|we|call|email|phone|leadership|tel"
)
NAME_CUT = rf"\b(?:{_ROLES}|{_NOT_NAMES})\b|[|•·,;:()&/–—.]|\s-\s"
COPYRIGHT = r"(?i)(?:©|&copy;|copyright)[^0-9]{0,30}(?:\d{4}\s*[-–—]\s*)?(20\d\d|19\d\d)"
PRIVACY = r"privacy|datenschutz|confidential|privacidad|privacidade|конфиденциальн|персональных данных"
COOKIE = r"cookie|куки"

# (name, category, pattern on lower-case html)
TECHNOLOGIES = [
    ("wordpress", "cms", r"/wp-content/|/wp-includes/"),
    ("woocommerce", "ecommerce", r"woocommerce"),
    ("shopify", "ecommerce", r"cdn\.shopify\.com|myshopify\.com"),
    ("wix", "cms", r"static\.wixstatic\.com|wix-code|x-wix-"),
    ("squarespace", "cms", r"static1\.squarespace\.com|squarespace-cdn"),
    ("webflow", "cms", r"webflow\.(js|css|io)|assets\.website-files\.com|data-wf-page"),
    ("framer", "cms", r"framerusercontent\.com|framer\.com/m/"),
    ("tilda", "cms", r"tildacdn|tilda\.(ws|cc)"),
    ("bitrix", "cms", r"/bitrix/(js|templates|cache)"),
    ("joomla", "cms", r"/media/jui/|/components/com_"),
    ("drupal", "cms", r"drupal-settings-json|/sites/default/files/"),
    ("ghost", "cms", r"ghost-(portal|sdk)|content=\"ghost"),
    ("hubspot-cms", "cms", r"hs-sites\.com|/hs-fs/hubfs/"),
    ("duda", "cms", r"dudaone|multiscreensite"),
    ("godaddy-builder", "cms", r"img1\.wsimg\.com"),
    ("weebly", "cms", r"weebly\.com/"),
    ("jimdo", "cms", r"jimdo(cdn)?\.com"),
    ("magento", "ecommerce", r"mage/cookies|/static/version\d+/frontend/"),
    ("prestashop", "ecommerce", r"prestashop"),
    ("opencart", "ecommerce", r"catalog/view/theme"),
    ("bigcommerce", "ecommerce", r"cdn\d*\.bigcommerce\.com"),
    ("ecwid", "ecommerce", r"app\.ecwid\.com"),
    ("insales", "ecommerce", r"insales"),
    ("flexbe", "cms", r"flexbe"),
    ("nethouse", "cms", r"nethouse"),
    ("craftum", "cms", r"craftum"),
    ("ukit", "cms", r"ukit|ucoz"),
    ("nextjs", "framework", r"/_next/static/"),
    ("nuxt", "framework", r"/_nuxt/"),
    ("gatsby", "framework", r"___gatsby"),
    ("astro", "framework", r"astro-island|/_astro/"),
    ("google-analytics", "analytics", r"gtag\(|google-analytics\.com/|googletagmanager\.com/gtag"),
    ("google-tag-manager", "analytics", r"googletagmanager\.com/gtm\.js"),
    ("yandex-metrika", "analytics", r"mc\.yandex\.ru/(metrika|watch)"),
    ("meta-pixel", "analytics", r"connect\.facebook\.net/[^\"']*/fbevents\.js|fbq\("),
    ("linkedin-insight", "analytics", r"snap\.licdn\.com/li\.lms-analytics"),
    ("hotjar", "analytics", r"static\.hotjar\.com"),
    ("clarity", "analytics", r"clarity\.ms/tag"),
    ("tiktok-pixel", "analytics", r"analytics\.tiktok\.com"),
    ("vk-pixel", "analytics", r"vk\.com/js/api/openapi|top-fwz1\.mail\.ru"),
    ("plausible", "analytics", r"plausible\.io/js"),
    ("intercom", "chat", r"widget\.intercom\.io|intercomcdn"),
    ("drift", "chat", r"js\.driftt\.com"),
    ("crisp", "chat", r"client\.crisp\.chat"),
    ("tawk", "chat", r"embed\.tawk\.to"),
    ("livechat", "chat", r"cdn\.livechatinc\.com"),
    ("zendesk", "chat", r"static\.zdassets\.com|zopim"),
    ("hubspot-chat", "chat", r"js\.usemessages\.com"),
    ("freshchat", "chat", r"wchat\.freshchat\.com"),
    ("tidio", "chat", r"code\.tidio\.co"),
    ("jivo", "chat", r"code\.jivo(site)?\.(ru|com)"),
    ("whatsapp-widget", "chat", r"wa\.me/|api\.whatsapp\.com/send"),
    ("calendly", "booking", r"calendly\.com/"),
    ("acuity", "booking", r"acuityscheduling\.com"),
    ("setmore", "booking", r"setmore\.com"),
    ("simplybook", "booking", r"simplybook\.(me|it|asia)"),
    ("square-appointments", "booking", r"square\.site|squareup\.com/appointments"),
    ("booksy", "booking", r"booksy\.com"),
    ("fresha", "booking", r"fresha\.com"),
    ("treatwell", "booking", r"treatwell\."),
    ("doctolib", "booking", r"doctolib\."),
    ("zocdoc", "booking", r"zocdoc\.com"),
    ("opentable", "booking", r"opentable\.(com|co\.uk)"),
    ("resy", "booking", r"resy\.com"),
    ("thefork", "booking", r"thefork\."),
    ("yclients", "booking", r"yclients\.com"),
    ("dikidi", "booking", r"dikidi\.(net|ru)"),
    ("cal-com", "booking", r"cal\.com/"),
    ("hubspot", "crm", r"js\.hs-scripts\.com|js\.hsforms\.net|hs-analytics"),
    ("salesforce", "crm", r"pardot\.com|salesforce\.com/servlet"),
    ("zoho", "crm", r"zoho\.(com|eu)/(crm|salesiq)|salesiq\.zoho"),
    ("pipedrive", "crm", r"pipedrivewebforms|leadbooster"),
    ("amocrm", "crm", r"amocrm\.(ru|com)|amoforms"),
    ("bitrix24", "crm", r"bitrix24\.(ru|com|by|kz)/b\d+/crm/form|b24-form"),
    ("mailchimp", "email-marketing", r"list-manage\.com|chimpstatic\.com"),
    ("klaviyo", "email-marketing", r"klaviyo\.com"),
    ("activecampaign", "email-marketing", r"activehosted\.com|trackcmp\.net"),
    ("typeform", "forms", r"typeform\.com"),
    ("jotform", "forms", r"jotform\.(com|us)"),
    ("google-forms", "forms", r"docs\.google\.com/forms"),
    ("marquiz", "forms", r"marquiz"),
    ("contact-form-7", "forms", r"wpcf7"),
    ("stripe", "payments", r"js\.stripe\.com"),
    ("paypal", "payments", r"paypal\.com/sdk|paypalobjects"),
    ("yookassa", "payments", r"yookassa|yoomoney"),
    ("cloudpayments", "payments", r"cloudpayments"),
    ("cookiebot", "consent", r"consent\.cookiebot\.com"),
    ("onetrust", "consent", r"cdn\.cookielaw\.org|onetrust"),
    ("cookieyes", "consent", r"cookieyes\.com"),
]

# Suffix of a mail exchanger's host and the provider behind it; the first match counts.
MX_PROVIDERS = [
    (r"(aspmx\.l\.google\.com|googlemail\.com|google\.com|smtp\.google\.com)$", "google-workspace"),
    (r"mail\.protection\.outlook\.com$|outlook\.com$|hotmail\.com$", "microsoft-365"),
    (r"zoho\.(com|eu|in|com\.au)$", "zoho"),
    (r"(mx\.yandex\.(net|ru)|yandex\.(net|ru))$", "yandex-360"),
    (r"mail\.ru$", "vk-workspace"),
    (r"protonmail\.ch$|proton\.me$", "proton"),
    (r"messagingengine\.com$", "fastmail"),
    (r"icloud\.com$|me\.com$", "icloud"),
    (r"pphosted\.com$|ppe-hosted\.com$", "proofpoint"),
    (r"mimecast\.com$", "mimecast"),
    (r"barracudanetworks\.com$", "barracuda"),
    (r"secureserver\.net$", "godaddy"),
    (r"(registrar-servers|privateemail)\.com$", "namecheap"),
    (r"(ionos|1and1|kundenserver)\.[a-z.]+$", "ionos"),
    (r"ovh\.net$", "ovh"),
    (r"hostinger\.[a-z.]+$|titan\.email$", "hostinger"),
    (r"gmx\.[a-z.]+$|web\.de$", "gmx"),
    (r"amazonaws\.com$|amazonses\.com$", "amazon"),
    (r"beget\.(com|ru)$", "beget"),
    (r"timeweb\.ru$", "timeweb"),
    (r"(reg\.ru|hosting\.reg\.ru)$", "reg-ru"),
    (r"sprinthost\.ru$", "sprinthost"),
]

# Part of a sender policy and the tool that it allows.
SPF_TOOLS = [
    ("_spf.google.com", "google-workspace"), ("spf.protection.outlook.com", "microsoft-365"), ("zoho", "zoho"), ("sendgrid.net", "sendgrid"), ("mailgun.org", "mailgun"),
    ("servers.mcsv.net", "mailchimp"), ("mandrillapp.com", "mandrill"), ("amazonses.com", "amazon-ses"), ("_spf.salesforce.com", "salesforce"), ("hubspotemail.net", "hubspot"),
    ("sparkpostmail.com", "sparkpost"), ("spf.mtasv.net", "postmark"), ("mailjet.com", "mailjet"), ("sendinblue.com", "brevo"), ("brevo.com", "brevo"), ("_spf.yandex.net", "yandex-360"),
    ("spf.mail.ru", "vk-workspace"), ("unisender", "unisender"), ("freshdesk.com", "freshdesk"), ("zendesk.com", "zendesk"), ("intercom", "intercom"), ("helpscout", "helpscout"),
    ("klaviyo", "klaviyo"), ("activecampaign", "activecampaign"),
]
