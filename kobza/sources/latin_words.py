"""Latin words with a reading of their own."""

# Brands and common English words.
BRANDS = {
    "google": "гугл", "python": "пайтон", "ios": "айос", "iphone": "айфон", "windows": "віндовс", "microsoft": "майкрософт",
    "apple": "епл", "facebook": "фейсбук", "youtube": "ютуб", "twitter": "твітер", "instagram": "інстаграм",
    "telegram": "телеграм", "whatsapp": "вотсап", "skype": "скайп", "android": "андроїд", "samsung": "самсунг", "linux": "лінукс",
    "internet": "інтернет", "online": "онлайн", "email": "імейл", "ok": "окей", "openai": "опеней", "chatgpt": "чатджипіті",
    "github": "гітхаб", "gitlab": "гітлаб", "macbook": "макбук", "ipad": "айпад", "airpods": "еірподс", "gmail": "джимейл",
    "zoom": "зум", "slack": "слак", "docker": "докер", "kubernetes": "кубернетіс", "react": "ріакт", "node": "ноуд",
    "javascript": "джаваскрипт", "typescript": "тайпскрипт", "adobe": "адобі", "amazon": "амазон", "netflix": "нетфлікс",
    "spotify": "спотіфай", "tiktok": "тікток", "linkedin": "лінкедін", "reddit": "реддіт", "wikipedia": "вікіпедія",
    "firefox": "фаєрфокс", "chrome": "хром", "chromium": "хроміум", "safari": "сафарі", "opera": "опера", "discord": "діскорд",
    "steam": "стім", "playstation": "плейстейшн", "xbox": "іксбокс", "nintendo": "нінтендо", "intel": "інтел", "tesla": "тесла",
    "oracle": "оракл", "dropbox": "дропбокс", "viber": "вайбер", "pinterest": "пінтерест", "snapchat": "снепчат",
    "messenger": "месенджер", "outlook": "аутлук", "yahoo": "яху", "bing": "бінг", "twitch": "твіч", "mastodon": "мастодон",
    "notion": "ноушн", "figma": "фігма", "canva": "канва", "trello": "трелло", "jira": "джира", "bitbucket": "бітбакет",
    "wordpress": "вордпрес", "django": "джанго", "angular": "ангуляр", "firebase": "файрбейс", "paypal": "пейпал", "uber": "убер",
    "glovo": "глово", "ikea": "ікеа", "lego": "лего", "disney": "дісней", "nike": "найк", "adidas": "адідас", "lenovo": "леново",
    "asus": "асус", "dell": "делл", "rozetka": "розетка", "privatbank": "приватбанк", "monobank": "монобанк", "diia": "дія",
    "ukrposhta": "укрпошта", "kyivstar": "київстар", "lifecell": "лайфселл", "vodafone": "водафон", "comfy": "комфі",
    "foxtrot": "фокстрот", "epicentr": "епіцентр", "silpo": "сільпо",
}
ENGLISH = {
    "python": "пайтон", "java": "джава", "javascript": "джаваскрипт", "typescript": "тайпскрипт", "docker": "докер",
    "kubernetes": "кубернетіс", "linux": "лінукс", "windows": "віндовс", "macos": "макос", "google": "гугл", "shop": "шоп",
    "server": "сервер", "client": "клієнт", "cloud": "клауд", "api": "ей пі ай", "web": "веб", "online": "онлайн",
    "offline": "офлайн", "browser": "браузер", "plugin": "плагін", "chat": "чат", "bot": "бот", "code": "код", "file": "файл",
    "script": "скрипт", "test": "тест", "build": "білд", "release": "реліз", "update": "апдейт", "backup": "бекап",
    "cache": "кеш", "database": "дейтабейс", "frontend": "фронтенд", "backend": "бекенд", "framework": "фреймворк",
    "download": "даунлоуд", "upload": "аплоуд", "account": "акаунт", "login": "логін", "token": "токен", "mobile": "мобайл",
    "desktop": "десктоп", "message": "меседж", "feature": "фіча", "bug": "баг", "link": "лінк", "click": "клік",
    "compiler": "компайлер", "runtime": "рантайм", "thread": "тред", "stack": "стек", "heap": "хіп", "index": "індекс",
    "data": "дейта", "dataset": "дейтасет", "model": "модель", "prompt": "промпт", "query": "квері", "user": "юзер",
    "admin": "адмін", "website": "вебсайт", "network": "нетворк", "privacy": "прайвесі", "audio": "аудіо", "video": "відео",
    "error": "ерор", "debug": "дебаг", "deploy": "деплой", "install": "інстал", "library": "лайбрарі", "array": "ерей",
    "string": "стрінг", "object": "об'єкт", "method": "метод", "process": "процес", "task": "таск", "job": "джоб",
    "input": "інпут", "output": "аутпут", "status": "статус", "config": "конфіг", "terminal": "термінал", "console": "консоль",
    "driver": "драйвер", "router": "роутер", "switch": "світч", "socket": "сокет", "kernel": "кернел", "memory": "меморі",
    "storage": "сторидж", "device": "девайс", "screen": "скрін", "display": "дисплей", "monitor": "монітор", "printer": "принтер",
    "scanner": "сканер",
}
