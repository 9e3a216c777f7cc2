"""Facts about languages that detection rests on."""

from __future__ import annotations

# Words frequent in one language and rare in the others, by language.
STOPWORDS = {
    "en": "the and of to is that with this for from have are was will would should which their there been were what when your you not but all can has more than then them these they into only other some such use used using does after before between during without while where about again each both must may its it be",
    "fr": "les des une dans pour avec sans mais donc être cette qui que dont où aussi ainsi alors après avant chaque comme encore entre leur même notre nous plus quand sont sous tout toute toutes tous très vous votre elle depuis déjà peut peuvent selon lorsque ceux celle celui jamais toujours était sera faire fait doit doivent ne pas du au aux est ou si par sur un le",
    "es": "los las una del para con pero porque cuando más muy este esta estos sobre hasta desde también así según después hacer tiene puede está están ser son todo todos otro otra aunque mientras entre sin que el un se lo",
    "de": "der die das den dem eine einen einem und nicht mit für von auf aus bei nach über unter durch ohne wird werden wurde sind ist war haben hat kann können muss müssen soll auch aber wenn dann noch nur schon sehr mehr alle diese dieser dieses welche zum zur ein",
    "it": "il gli della delle dei per con perché quando più molto questo questa sono essere anche ancora dopo nella nel sulla sul senza come tutto tutti può deve fare prima tra una che non del",
    "pt": "os das dos para com mas porque quando mais muito este esta são ter fazer pode também ainda depois não já só você sem sobre até desde onde como todos uma ser que nao",
    "nl": "het een van met voor aan door naar uit bij niet maar ook als wel kunnen moeten wordt worden zijn hebben heeft deze dit dat die alle meer zeer over onder kan moet zich nog",
    "sv": "och att det som en på är för med den har de inte om ett men var kan från eller när också efter utan över mycket alla andra sedan vara",
    "da": "og det som på er for med den har de ikke om et men var kan fra eller når også efter uden over meget alle andre siden være til af",
    "pl": "nie jest się że na do to jak ale lub oraz przez dla przy pod nad bez być może także jeszcze tylko bardzo wszystkie który która które gdy już tego",
    "ro": "este sunt care pentru din cu nu dar sau când unde cum mai foarte toate acest această poate trebuie după înainte între fără despre până deja încă",
    "tr": "bir için ile bu da de ve veya ama çok daha gibi kadar sonra önce olarak olan var yok değil her bütün hangi nasıl neden zaman",
    "ru": "и в не на что с по это для как все или но если может быть уже при так его нет вы из",
    "ja": "",
}
LANGUAGES = tuple(STOPWORDS)

# Fixed values: (language, pattern, weight) of spellings that tell languages apart. Case is spelt out.
ORTHOGRAPHY = (
    ("es", "[ñ¿¡]", 1.0),
    ("pt", "[ãõÃÕ]", 1.0),
    ("de", "[äöüßÄÖÜ]", 0.85),
    ("pl", "[ąćęłńśźżĄĆĘŁŃŚŹŻ]", 1.0),
    ("ro", "[ășțĂȘȚ]", 0.95),
    ("tr", "[ğışİĞŞ]", 0.95),
    ("da", "[æøÆØ]", 0.8),
    ("fr", "[œŒ]", 0.9),
    ("fr", "(^|[\\s(«\"'])(?i:qu|d|l|n|s|j|c|m|t)['’]\\p{L}", 0.8),
    ("it", "(^|\\s)(?i:dell|nell|all|un|dall|sull)['’]", 0.8),
    ("es", "(?i:ci[óÓ]n|ciones|miento|dad)\\b", 0.9),
    ("pt", "(?i:[çÇ][ãÃ]o|[çÇ][õÕ]es|agem)\\b", 0.9),
    ("it", "(?i:zione|zioni|it[àÀ]|mente)\\b", 0.75),
    ("de", "(?i:ung|keit|heit|schaft)\\b", 0.7),
    ("fr", "(?i:ement|tion|eux|it[éÉ])\\b", 0.3),
    ("en", "(?i:tion|ing|ness|ment)\\b", 0.35),
    ("fr", "[éèêëàâçîïôùûüÉÈÊËÀÂÇÎÏÔÙÛÜ]", 0.3),
    ("it", "[àèéìòùÀÈÉÌÒÙ]", 0.2),
    ("pt", "[áéíóúâêôçÁÉÍÓÚÂÊÔÇ]", 0.2),
    ("es", "[áéíóúüÁÉÍÓÚÜ]", 0.2),
    ("sv", "[åäÅÄ]", 0.5),
)

# Words that are spelt alike in several languages.
COGNATES = "notifications notification format options option configuration instructions instruction sessions session import export interface version menu application applications documentation installation navigation information action actions section sections description position direction transition animation expression extension extensions test tests sport transport client auto radio audio video photo zone zones total normal local global social central digital orange simple double triple stable principal important different permanent moment instant accent".split()

# Scripts that settle a language, in Java's and RE2's spelling.
SCRIPTS = (("ru", r"\p{IsCyrillic}", r"\p{Cyrillic}"), ("ja", r"[\p{IsHiragana}\p{IsKatakana}]", r"[\p{Hiragana}\p{Katakana}]"))

# What isn't prose and is blanked before detection, in this order.
NOT_PROSE = (
    r"\{\d+\}",
    r"\{\{[^}]*\}\}",
    r"%[sd@]|%\d+\$[sd@]",
    r"https?://\S+|\b[\w.-]+/[\w./-]+",
    r"`[^`]*`",
    r"<[^>]+>",
    r"\b[a-z]+[A-Z]\w*",
    r"\b[A-Z][A-Z0-9_]{2,}\b",
    r"\b\w+[_-]\w+\b",
    r"\b\w+(?:\.\w+)+\b",
    r"\d+",
)

# One sentence of each language, for the self test.
SAMPLES = {
    "en": "The quick brown fox jumps over the lazy dog and then goes back to sleep.",
    "fr": "Le renard brun et rapide saute par-dessus le chien paresseux, puis s'en retourne dormir.",
    "es": "El rápido zorro marrón salta sobre el perro perezoso y luego vuelve a dormir.",
    "de": "Der schnelle braune Fuchs springt über den faulen Hund und legt sich wieder schlafen.",
    "it": "La rapida volpe marrone salta sopra il cane pigro e poi torna a dormire.",
    "pt": "A rápida raposa castanha salta sobre o cão preguiçoso e depois volta a dormir.",
    "nl": "Het is niet mogelijk om deze instellingen op te slaan zonder een geldig adres.",
    "sv": "Det är inte möjligt att spara dessa inställningar utan en giltig adress.",
    "da": "Det er ikke muligt at gemme disse indstillinger uden en gyldig adresse.",
    "pl": "Nie można zapisać tych ustawień bez podania prawidłowego adresu.",
    "ro": "Nu este posibil să salvați aceste setări fără o adresă validă.",
    "tr": "Geçerli bir adres olmadan bu ayarları kaydetmek mümkün değildir.",
    "ru": "Невозможно сохранить эти настройки без указания действительного адреса.",
    "ja": "有効なアドレスを指定せずにこれらの設定を保存することはできません。",
}

# Words of file names, by language; a word of two lists belongs to the later one.
PATH_WORDS = {
    "fr": "reglages réglages parametres paramètres accueil connexion deconnexion inscription recherche resultats résultats clair sombre gris rouge vert bleu jaune noir blanc grand petit moyen nouveau nouvelle ancien page pages image images capture captures ecran écran exemple exemples modele modèle brouillon apercu aperçu utilisateur utilisateurs compte comptes profil tableau graphique statistiques minuteur tache tâche taches tâches alerte alertes sonnerie demarrage démarrage arret arrêt pause aide guide accessibilite accessibilité securite sécurité donnees données fichier dossier",
    "es": "ajustes configuracion configuración inicio busqueda búsqueda claro oscuro rojo verde azul negro blanco grande pequeno pequeño nuevo nueva pagina página imagen imagenes imágenes pantalla ejemplo usuario usuarios cuenta perfil datos archivo carpeta tarea tareas ayuda guia guía seguridad",
    "de": "einstellungen anmeldung abmeldung suche hell dunkel rot gruen grün blau schwarz weiss weiß gross groß klein neu seite seiten bild bilder bildschirm beispiel benutzer konto profil daten datei ordner aufgabe aufgaben hilfe sicherheit",
    "it": "impostazioni accesso ricerca chiaro scuro rosso verde blu nero bianco grande piccolo nuovo nuova pagina immagine immagini schermo esempio utente account profilo dati file cartella attivita attività aiuto sicurezza",
    "pt": "configuracoes configurações ajustes inicio início busca claro escuro vermelho verde azul preto branco grande pequeno novo nova pagina página imagem imagens tela exemplo usuario usuário conta perfil dados arquivo pasta tarefa tarefas ajuda seguranca segurança",
}
