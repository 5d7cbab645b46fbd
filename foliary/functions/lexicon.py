"""Word lists and codes."""

# Fixed values that must equal the reference's for right results.
STOPWORDS = {
    "es": "el la los las de del con para por una experiencia educacion habilidades idiomas actualidad desarrollador desarrolladora ingeniero ingeniera licenciatura universidad trabajo empresa años anos perfil formacion cursos certificaciones referencias nivel avanzado intermedio nativo".split(),
    "en": "the and with for of experience education skills languages present developer engineer bachelor university work company years summary profile courses certifications references level advanced intermediate native fluent".split(),
    "pt": "o os as do da dos das com para uma experiencia educacao formacao habilidades idiomas atualmente desenvolvedor desenvolvedora engenheiro engenheira universidade trabalho empresa anos cursos certificacoes referencias nivel avancado intermediario nativo fluente não nao".split(),
}
ENTITY_STOPWORDS = "de del la las el los y e en the of and at a s sa srl sl sas sac spa ltda inc llc ltd cv r l c v".split()
NAME_PARTICLES = "de del la las los y".split()
COUNTRY_CODES = "1 7 33 34 39 44 49 51 52 53 54 55 56 57 58 351 502 503 504 505 506 507 591 593 595 598".split()
CITY_ALIASES = {
    "ciudad autonoma de buenos aires": "buenos aires", "ciudad de buenos aires": "buenos aires", "capital federal": "buenos aires", "caba": "buenos aires",
    "ciudad de mexico": "ciudad de mexico", "mexico d f": "ciudad de mexico", "mexico df": "ciudad de mexico", "cdmx": "ciudad de mexico", "bogota d c": "bogota", "bogota dc": "bogota",
}
LANGUAGE_NAMES = {
    "es": "espanol castellano spanish espanhol", "en": "ingles english", "pt": "portugues portuguese", "fr": "frances french francais", "de": "aleman german deutsch alemao",
    "it": "italiano italian", "ca": "catalan catala", "gl": "gallego galician", "eu": "euskera vasco basque", "zh": "chino mandarin chinese", "ja": "japones japanese", "ko": "coreano korean",
    "ru": "ruso russian", "ar": "arabe arabic", "he": "hebreo hebrew", "nl": "neerlandes holandes dutch", "gn": "guarani", "qu": "quechua", "ay": "aimara aymara",
}
ONGOING = (
    "actualidad", "actual", "actualmente", "presente", "present", "a la fecha", "hasta la fecha", "hasta el presente", "hasta la actualidad", "hasta hoy", "hoy", "en curso", "vigente", "current",
    "currently", "now", "ongoing", "to date", "till date", "today", "atualmente", "atual", "presente momento", "ate o momento", "in progress", "en progreso", "em andamento", "em curso", "cursando",
)
MONTH_WORDS = (
    "enero ene january jan janeiro", "febrero feb february fevereiro fev", "marzo mar march marco", "abril abr april apr", "mayo may maio", "junio jun june junho",
    "julio jul july julho", "agosto ago august aug", "septiembre setiembre sep sept set september setembro", "octubre oct october outubro out", "noviembre nov november novembro", "diciembre dic december dec dezembro dez",
)
SEASONS = {3: "primavera spring", 6: "verano verao summer", 9: "otono autumn fall outono", 12: "invierno winter inverno"}
NUMBER_WORDS = {
    1: "un una uno um uma a an one", 2: "dos dois duas two", 3: "tres three", 4: "cuatro quatro four", 5: "cinco five", 6: "seis six", 7: "siete sete seven", 8: "ocho oito eight",
    9: "nueve nove nine", 10: "diez dez ten", 11: "once onze eleven", 12: "doce twelve", 15: "quince fifteen", 20: "veinte vinte twenty",
}
ORDINALS = {1: "primer primero primera primeiro primeira first", 2: "segundo segunda second", 3: "tercer tercero tercera terceiro terceira third", 4: "cuarto cuarta quarto quarta fourth", 5: "quinto quinta fifth", 6: "sexto sexta sixth"}
PERIODS = {3: "trimestre trimestres trimester quarter qtr q t", 6: "semestre semester half mitad metade s h", 4: "cuatrimestre cuadrimestre quadrimestre quadrimester", 2: "bimestre bimester"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
ROLE_WORDS = (
    "abogado abogada accountant administrador administradora administrativo administrativa administrator analista analyst architect arquitecto arquitecta asesor asesora asistente assistant auxiliar becario becaria "
    "cajero cajera ceo cfo chef cientifico cientifica cocinero cocinera contador contadora coo coordinador coordinadora coordinator consultant consultor cto desarrollador desarrolladora designer developer devops "
    "director directora disenador disenadora docente editor editora ejecutivo ejecutiva enfermero enfermera engineer especialista founder cofounder co-founder fundador fundadora gerente head ingeniero ingeniera intern "
    "investigador investigadora jefe jefa lawyer lead lider manager medico medica nurse operario operaria owner pasante practicante profesor profesora programador programadora programmer qa recepcionista redactor "
    "redactora representante researcher responsable scientist specialist supervisor supervisora teacher technician tecnico tecnica tester vendedor vendedora writer"
).split()
ORG_WORDS = (
    "agencia agency alcaldia asamblea ayuntamiento banco bank centro clinica clinic colegio college company compania congreso consultora consultorio cooperativa empresa escuela estudio foundation fundacion gobierno group "
    "grupo hospital institute instituto intendencia laboratorio labs legislatura ministerio municipalidad mutual policlinico sanatorio school senado services servicios solutions soluciones technologies tecnologias "
    "universidad universitat university"
).split()
NAME_CONNECTORS = "de del la las los el y e & of the and for".split()
#: A legal form at the end of a folded name.
LEGAL_SUFFIX = r"(?:^|[\s,])(?:s\.?\s?a\.?(?:\s?(?:p\.?\s?i\.?|b\.?|s\.?|c\.?))?(?:\s?de c\.?\s?v\.?)?|s\.?\s?de r\.?\s?l\.?(?:\s?de c\.?\s?v\.?)?|s\.?\s?r\.?\s?l\.?(?:\s?de c\.?\s?v\.?)?|s\.?\s?l\.?|s\.?\s?c\.?|ltda\.?|inc\.?|llc\.?|ltd\.?|gmbh|corp\.?|spa|plc|co\.)$"
LEVEL_PHRASES = (
    "native or bilingual proficiency", "full professional proficiency", "professional working proficiency", "limited working proficiency", "elementary proficiency", "idioma materno", "lengua materna", "lingua materna",
    "lingua nativa", "mother tongue", "native speaker", "upper intermediate", "upper-intermediate", "pre-intermediate", "lectura tecnica", "muy bueno", "en curso",
)
LEVEL_WORDS = (
    "conversational conversacional intermediario intermediate intermedio intermedia principiante elementary proficient bilingual bilingue avanzado avanzada avancado advanced elemental beginner materno materna nativo nativa "
    "native fluent fluido fluida fluente basico basica basic nivel level profesional professional tecnico tecnica technical lectura comprension escritura escrito oral hablado reading writing speaking listening spoken written "
    "medio media alto alta bajo baja bueno buena buen good excelente excellent dominio competente competent limited limitado working proficiency regular notions nociones escolar cursando"
).split()
LOW_VALUE_HEADINGS = (
    "publicaciones", "publications", "congresos", "conferences", "ponencias", "comunicaciones", "proyectos de investigacion", "research projects", "comites", "committees", "revisiones", "reviews", "referencias", "references",
    "intereses", "interests", "hobbies", "otros meritos", "meritos", "merits", "actividades academicas", "academic activities", "tribunales", "estancias", "research stays",
)
HEADING_PREFIXES = "otros otras mis principales other selected recent".split()


def by_word(groups) -> dict[str, int]:
    """word -> key of a dict of word lists, or place from 1 in a tuple of them."""
    pairs = groups.items() if isinstance(groups, dict) else enumerate(groups, 1)
    return {w: k for k, words in pairs for w in words.split()}
