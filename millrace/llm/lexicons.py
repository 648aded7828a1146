"""Dictionaries for judging answers: languages, refusals, placeholders, labels of pairs."""

from __future__ import annotations

import re

#: Frequent short words that tell the languages written in Latin letters apart: function words as any grammar lists them.
STOPWORDS: dict[str, frozenset[str]] = {
    "en": frozenset(
        "the and of to is that it was for on are with as his they be at this have from or by but what all were when we there can an your which their said if will each about how up out them then she many some so these would into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know through back much before also around another came come work three word must because does part even place well such here take why help put different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next below both seen near inside beyond toward past beside across against beneath behind above within until unless since although whereas once neither nor a an no without each its people most seen stage set run more than".split()
    ),
    "de": frozenset("der die das und ist nicht ein eine einen einem einer mit auf für von zu den im dem des auch wenn wird nur bei sich sagt genau warum niemand aus wie ich sie er es wir ihr dass aber oder als noch nach um am sind war hat haben kann können über unter zwischen durch vor seit gegen ohne weil dann schon sehr mehr hier dort bleibt zeigt leider bitte muss keine kein wurde werden zum zur vom beim so man".split()),
    "es": frozenset("el la los las de que y en un una es por con para no se del al su sus más cuando parece queda como pero este esta esto ese esa lo le les me te nos muy ya también sin sobre entre hasta desde donde quien porque hay fue era son está están ser tiene cada todo nada nadie siempre aunque hacia bajo según cómo qué por".split()),
    "fr": frozenset("le la les des du et est que qui dans un une pour pas sur avec au aux par il elle nous vous ils ce cette ces mais ou où donc comme plus très sans sous entre être sont était avoir leur leurs on ne se sa son ses quand parce".split()),
    "it": frozenset("il lo la gli le di che e è un una per non con su del della dei delle nel nella sono come più ma anche questo questa quando dove perché si ci al alla dal dalla tra fra ogni molto senza sopra sotto".split()),
    "pt": frozenset("o os as um uma de que e é em do da dos das no na nos nas para por com não se mais como mas ao à pelo pela quando onde porque seu sua são foi ser está também muito sem sobre entre até".split()),
    "nl": frozenset("de het een en van is dat niet op te zijn met voor aan er maar om ook als bij uit naar door over ze hij wij deze dit worden werd heeft hebben kan nog wel geen waar wanneer omdat".split()),
    "sv": frozenset("och att det som en på är av för med till den har inte om ett men var jag sig från vi så kan när år också eller hon han de ut hur mycket där efter utan under mellan eftersom alla mot bara blir".split()),
    "da": frozenset("og at det som en på er af for med til den har ikke om et men var jeg sig fra vi så kan når også eller hun han de hvor meget der efter uden under mellem fordi alle kun bliver hvad".split()),
    "pl": frozenset("i w nie na się z do że jest to jak po co ale o od tak za przez jego być czy już dla są może tylko ich był oraz gdy kiedy który która które aby lub przed pod nad bez ponieważ".split()),
    "vi": frozenset("là và của có không được cho người trong một các những này với để đã khi tôi bạn ở từ như nhưng vì rất cũng thì lại đến về trên dưới sẽ nên mùa".split()),
    "tr": frozenset("ve bir bu da de için ile çok ne var daha gibi ama olarak o kadar değil mi en sonra çünkü her olan veya ise ki nasıl".split()),
    "id": frozenset("yang dan di ini itu dengan untuk tidak dari dalam akan pada juga ke karena adalah ada oleh saya atau bisa mereka kami telah sudah".split()),
}
SCRIPTS = {
    "zh": re.compile("[㐀-䶿一-鿿豈-﫿]"),
    "ja": re.compile("[぀-ヿ]"),
    "ko": re.compile("[가-힯ᄀ-ᇿ]"),
    "ru": re.compile("[Ѐ-ӿ]"),
    "ar": re.compile("[؀-ۿ]"),
    "el": re.compile("[Ͱ-Ͽ]"),
    "hi": re.compile("[ऀ-ॿ]"),
    "he": re.compile("[֐-׿]"),
    "th": re.compile("[฀-๿]"),
}
_NAMES = {
    "en": r"english|englisch|englische|inglés|ingles|inglês|inglese|anglais|engels|engelska|engelsk|angielsku|английск\w+|ingilizce|inggris|tiếng anh|英文|英语|英語|영어",
    "zh": "chinese|mandarin|chinesisch|chino|chinois|中文|汉语|漢語|华语|普通话",
    "de": "german|deutsch|deutsche|alemán|aleman|allemand|德文|德语",
    "es": "spanish|spanisch|español|espanol|castellano|espagnol|西班牙文|西班牙语",
    "fr": "french|französisch|francés|français|法文|法语",
    "it": "italian|italienisch|italiano|意大利文|意大利语",
    "pt": "portuguese|portugiesisch|portugués|português|葡萄牙文|葡萄牙语",
    "nl": "dutch|niederländisch|neerlandés|荷兰文|荷兰语",
    "ja": "japanese|japanisch|japonés|日文|日语|日本語",
    "ko": "korean|koreanisch|coreano|韩文|韩语|한국어",
    "ru": "russian|russisch|ruso|俄文|俄语",
    "ar": "arabic|arabisch|árabe|阿拉伯文|阿拉伯语",
    "sv": "swedish|schwedisch|sueco|suédois|瑞典文|瑞典语",
    "da": "danish|dänisch|danés|danois|丹麦文|丹麦语",
    "pl": "polish|polnisch|polaco|polonais|波兰文|波兰语",
    "vi": "vietnamese|vietnamesisch|vietnamita|vietnamien|越南文|越南语",
    "tr": "turkish|türkisch|turco|turc|土耳其文|土耳其语",
    "id": "indonesian|indonesisch|indonesio|indonésien|印尼文|印尼语",
    "el": "greek|griechisch|griego|grec|希腊文|希腊语",
    "hi": "hindi|印地文|印地语",
    "he": "hebrew|hebräisch|hebreo|hébreu|希伯来文|希伯来语",
    "th": "thai|thailändisch|tailandés|thaï|泰文|泰语",
}
#: A language is asked for by name: "in English", "auf Deutsch", "译成英文", "用中文".
ASKED = {code: re.compile(rf"(?:\b(?:in|into|to|auf|ins|nach|en|em|al|vers|as|på|po|na|на|bằng|ke|dalam bahasa)\s+(?:(?:the|plain|simple|your|das|el)\s+)?|[译譯翻成为為用以写寫说說]\s*)(?:{names})", re.I) for code, names in _NAMES.items()}

#: Whole answers (letters and digits only, case-folded) that stand for no answer.
PLACEHOLDERS = frozenset(
    "na nil none null nan nul empty blank tbd tba todo tbc void undefined unknown noanswer noresponse notavailable notapplicable noreply placeholder missing pending unanswered answerhere insertanswerhere youranswerhere addanswerhere emptystring emptyanswer leftblank nothing xxx lorem".split()
    + "keineantwort leer keineangabe ka offen sinrespuesta vacío vacio ninguno ninguna nada pendiente".split()
    + "无 空 暂无 没有 无答案 暂无答案 没有答案 无回答 未回答 无内容 空白 待定 待补充 略 缺失 未知 不适用 无回复 暂缺".split()
)

#: Clauses that decline, on text of words only (apostrophes dropped) or, for Chinese, without blanks.
_DECLINE_EN = re.compile(
    r"\b(?:can ?not|cant|could not|couldnt|wont|will not|am unable to|m unable to|im unable to|are unable to|unable to|am not able to|im not able to|not able to|be able to|am not allowed to|im not allowed to|not permitted to|refuse to|decline to|not going to|am not going to|do not want to|dont want to|not willing to|am not comfortable|must not|may not|do not wish to) (?:really |possibly |currently |actually )?(?:be (?:able to )?)?(?:help|helping|assist|assisting|answer|answering|respond|responding|reply|comply|provide|providing|give|offer|fulfil|fulfill|do (?:that|this|so)|discuss|discussing|support|share|complete|engage|going into|go into|treat|address|process|handle|continue with|comment|say anything|speak|talk)\b"
    r"|\b(?:have|has|need|must|want|obliged|forced|ll have) ?(?:to)? (?:respectfully |politely )?(?:decline|refuse|pass on this|abstain|say no|turn (?:this|that|it) down)\b"
    r"|\bi (?:respectfully |politely )?(?:decline|refuse|abstain)\b"
    r"|\b(?:rather|prefer|prefers|choose|best) not (?:to )?(?:answer|respond|reply|say|discuss|help|comment|go into|do (?:this|that)|touch|treat)\b"
    r"|\bnot in a position to (?:give|answer|help|respond|provide|say|comment|assist)\b"
    r"|\bnot (?:be )?(?:appropriate|right|proper|possible|able|allowed|suitable) for me to\b"
    r"|\bnot something (?:that )?i (?:can|could|may|am able to|am allowed to|will|am willing to|want to)\b"
    r"|\b(?:lies|falls|is|goes|are|sits) (?:well )?(?:outside|beyond|out)(?: of)? (?:what i (?:am|can|may)|my |the scope|the limits|the range)"
    r"|\b(?:leave|leaves|leaving) (?:this|that|your|the) (?:question|request|one|task|prompt) (?:unanswered|open|aside)\b"
    r"|\bno (?:answer|help|response|reply|comment) (?:can|will|may|could) (?:come|be given|be expected|be provided|follow)\b"
    r"|\b(?:guidelines|policy|policies|rules|instructions|principles|programming) (?:do not|dont|does not|doesnt|will not|wont|forbid|forbids|prohibit|prohibits|prevent|prevents|keep|keeps|bar|bars) "
    r"|\b(?:against|violates|breaches) (?:my|our) (?:guidelines|policy|policies|rules|principles|programming)\b"
    r"|\b(?:this|that|your|the) (?:request|question|topic|task) (?:must|has to|will have to|will|cannot|can not|cant) (?:be )?(?:declined|refused|denied|answered by me|remain unanswered|go unanswered)\b"
    r"|\b(?:i|we) (?:have|ve) no (?:way|means) (?:to|of) (?:answer|answering|help|helping|respond|responding|provid\w+|giv\w+)\b"
)
_DECLINE_ZH = re.compile(
    "恕难(?:从命|回答|奉告|答复|办理)|恕(?:我)?(?:不能|无法|不便)(?:回答|提供|协助|帮助|答复|满足|给出|处理|讨论|发表|透露|评论)|(?:不能|无法|没法|不可以|不便|不方便|不愿|不愿意|不想|不会|不宜|不予|没有办法|无力|难以)(?:对此|为您|为你|就此|在此|向您|向你|继续|再|直接|具体)*(?:提供|回答|协助|帮助|帮您|帮你|帮忙|答复|满足|给出|给您|给你|处理|讨论|发表|完成|回应|响应|透露|评论|谈论|执行|办到|做到|作答|解答|涉及)"
    "|(?:只能|必须|不得不|需要|选择|要|应当)(?:婉言|礼貌地)?(?:拒绝|谢绝|婉拒|推辞|回绝)|(?:拒绝|谢绝|婉拒)(?:回答|提供|这|该|您|你|此|协助)|超出(?:了)?(?:我|本助手|本模型)?的?(?:能力|权限|服务|职责|知识|允许)(?:的)?(?:范围)?|爱莫能助|无可奉告|(?:这|那|它)?不是我(?:能|可以|所能)|不在我的?(?:能力|职责|服务|权限|允许)|(?:不符合|违反)(?:了)?(?:我的|相关|使用)?(?:准则|规定|政策|原则)|不(?:被)?允许我|(?:保持|必须)沉默"
)
_DECLINE_DE = re.compile(
    r"\b(?:kann|darf|werde|möchte|will|könnte|mag) ich (?:leider |dir |ihnen |euch |dazu |hier |das |darauf |hierzu |diese\w* )*(?:nicht|keine?\w*|nichts)\b|\bich (?:kann|darf|werde|möchte|will) (?:\w+ ){0,4}(?:nicht|keine?\w*|nichts) (?:\w+ ){0,5}(?:helfen|antworten|beantworten|weiterhelfen|geben|sagen|erfüllen|behandeln|äussern|unterstützen|bearbeiten|eingehen)|\b(?:muss|müssen) (?:ich|wir) (?:\w+ ){0,4}(?:ablehnen|verweigern|passen|absagen)|\bich (?:muss )?(?:\w+ ){0,4}(?:lehne|ablehnen|verweigere|verweigern)\b|\b(?:ist|wäre) mir (?:\w+ ){0,2}nicht (?:möglich|erlaubt|gestattet)|\b(?:liegt|geht|fällt) (?:\w+ )?(?:ausserhalb|über) (?:meine\w*|mein)\b"
)
_DECLINE_ES = re.compile(
    r"\bno (?:me (?:es|está|resulta) (?:posible|permitido)|puedo|podré|podría|debo|quiero|voy a|estoy en condiciones|estoy autorizad\w|soy capaz|me corresponde|sería apropiado|es apropiado|es algo que pueda|tengo permitido)\b|\b(?:prefiero|preferiría|elijo) no \w+|\b(?:debo|tengo que|he de|me veo obligad\w a) (?:rechazar|declinar|negarme|abstenerme|rehusar)|\b(?:rechazo|declino|me niego|me abstengo)\b|\bqueda fuera de (?:mis|lo que)|\bestá fuera de (?:mi|mis|lo que)"
)
_DECLINE_EN_MORE = re.compile(
    r"\b(?:can ?not|cant|could not|couldnt|wont|will not|unable to|not able to|not going to|refuse to|decline to) (?:really |possibly |currently |actually )?(?:accommodate|entertain|oblige|honou?r|weigh in|advise|be of (?:any )?(?:help|service|assistance|use)|take (?:this|that|it|part)|write (?:this|that)|produce (?:this|that)|go there|touch (?:this|that)|speak to (?:this|that))\b"
    r"|\b(?:is|are|thats|its|falls|lies|goes) (?:well |far )?(?:beyond|outside) what i (?:can|could|may|am able to) (?:do|say|offer|answer|discuss)\b|\b(?:do not|dont|am not|m not) (?:feel )?(?:comfortable|at ease) (?:answering|discussing|writing|saying|with)\b"
    r"|\b(?:sit|sitting) (?:this|that)(?: one)? out\b|\bsteer(?:ing)? clear of (?:this|that|it|such)\b|\bcount me out\b|\bno comment\b|\boff limits (?:for|to) me\b|\bi(?: ll| will)? (?:have to )?pass on (?:this|that|it)\b|\b(?:this|that|it)s? (?:is )?not (?:my place|for me) to (?:say|answer|judge)\b"
)
_DECLINE_DE_MORE = re.compile(
    r"\b(?:kann|darf|werde|möchte|will|könnte|mag) (?:ich|wir) (?:\w+ ){0,6}(?:nicht|keine?\w*|nichts) (?:\w+ ){0,3}(?:helfen|antworten|beantworten|weiterhelfen|geben|sagen|erfüllen|behandeln|äussern|unterstützen|bearbeiten|eingehen|nachkommen)\b"
)
_DECLINE_FR = re.compile(
    r"\b(?:je|nous) (?:ne |n )?(?:peux|puis|pourrai|pourrais|souhaite|veux|vais|suis|pouvons|dois|saurais) (?:malheureusement |hélas |donc |vraiment )?(?:pas|point|rien) (?:\w+ ){0,4}(?:d?aider|(?:l|t|vous |te )?assister|(?:y |vous |te |lui )?répondre|fournir|donner|faire|dire|traiter|satisfaire|discuter|poursuivre|partager|accéder|mesure|autorisée?|capable|habilitée?|aider)\b"
    r"|\b(?:je|nous) (?:dois|devons|préfère|préférons|vais|me vois|suis) (?:\w+ ){0,5}(?:refuser|décliner|mabstenir|ne pas)\b|\bje (?:refuse|décline|mabstiens)\b|\b(?:ne )?mest (?:malheureusement )?(?:pas (?:possible|permis)|impossible|interdit)|\bimpossible pour moi\b|\bsort de (?:mes|ce que je)|\bdépasse (?:mes|ce que je)"
)
_DECLINE_PT = re.compile(
    r"\bnão (?:me é (?:possível|permitido)|posso|poderei|poderia|vou|consigo|devo|quero|estou (?:autorizad\w|em condições)|tenho (?:permissão|como)|é possível para mim|sou capaz)(?: \w+){0,4}? (?:ajudar|responder|fornecer|dar|atender|fazer|dizer|auxiliar|tratar|discutir|oferecer|isso|isto|te|lhe|a|de|para)\b|\bnão (?:me é (?:possível|permitido)|posso ajudar|posso responder)\b|\bprefiro não \w+|\b(?:devo|tenho (?:de|que)|preciso|sou obrigad\w a) (?:\w+ ){0,2}(?:recusar|declinar)|\b(?:recuso|recuso me|me recuso|declino)\b|\bfora d(?:o meu alcance|as minhas|e minhas)"
)
_DECLINE_IT = re.compile(
    r"\bnon (?:posso|potrò|potrei|sono (?:in grado|autorizzat\w|capace)|mi è (?:possibile|permesso|consentito)|voglio|intendo|riesco)(?: \w+){0,4}? (?:\w*aiutar\w*|risponder\w*|fornir\w*|dar\w*|fare|farlo|dire|assister\w*|trattar\w*|discuter\w*|soddisfar\w*|offrir\w*|di|a)\b|\bnon mi è (?:possibile|permesso|consentito)\b|\bpreferisco non \w+|\b(?:devo|sono costrett\w a) (?:\w+ ){0,2}(?:rifiutar\w*|declinar\w*)|\b(?:mi rifiuto|rifiuto|declino)\b|\b(?:esula|va oltre|fuori) (?:d\w+ )?(?:mi\w+|quanto)"
)
_DECLINE_NL = re.compile(
    r"\b(?:kan|mag|wil|zal) ik (?:\w+ ){0,5}(?:niet|geen|niets)\b|\bik (?:kan|mag|wil|zal|ben) (?:\w+ ){0,5}(?:niet|geen|niets) (?:\w+ ){0,4}(?:helpen|beantwoorden|antwoorden|geven|verstrekken|doen|zeggen|staat|bespreken|behandelen)|\bik moet (?:\w+ ){0,4}(?:weigeren|afwijzen|afslaan)|\bik weiger\b|\bliever niet\b"
)
_DECLINE_RU = re.compile(
    r"\bне (?:могу|сможем|смогу|буду|готов\w*|имею права|хочу|в состоянии|вправе|можем) (?:\w+ ){0,4}(?:помочь|помогать|ответить|отвечать|предоставить|дать|выполнить|обсуждать|сказать|сделать|комментировать)|\bвынужден\w* (?:\w+ ){0,2}отказать\w*|\b(?:я )?отказываюсь\b|\bпредпочту не \w+|\bпредпочитаю не \w+|\bвыходит за (?:рамки|пределы)"
)
#: Each clause that declines holds one of these words.
DECLINE_WORDS = frozenset(
    "not cannot cant couldnt wont dont unable refuse refused refuses decline declined declines declining abstain pass rather prefer prefers choose best something lies falls outside beyond out scope leave leaves leaving unanswered answer response reply comment help guidelines policy policies rules instructions principles programming against violates breaches denied way means down"
    " nicht keine keinen kein nichts ablehnen ablehne lehne verweigern verweigere passen absagen ausserhalb über puedo podré podría debo quiero voy estoy soy posible permitido corresponde apropiado prefiero preferiría elijo rechazar rechazo declinar declino negarme niego abstenerme abstengo rehusar fuera".split()
    + "comfortable ease sit sitting steer steering count comment limits pass place".split()
    + "pas point rien refuser refuse décliner décline mabstenir mabstiens ne mest impossible sort dépasse".split()
    + "não prefiro recusar recuso declinar declino fora non preferisco rifiutare rifiuto declinare rifiutarmi declinarla rifiutarla rifiutarlo declino esula oltre fuori devo".split()
    + "niet geen niets weigeren weiger afwijzen afslaan liever не отказываюсь отказать отказаться отказывать предпочту предпочитаю выходит вынужден вынуждена".split()
)
DECLINES = (_DECLINE_EN, _DECLINE_EN_MORE, _DECLINE_DE, _DECLINE_DE_MORE, _DECLINE_ES, _DECLINE_FR, _DECLINE_PT, _DECLINE_IT, _DECLINE_NL, _DECLINE_RU)
_DECLINE_JA = re.compile("(?:お答え|答える|回答|お手伝い|手伝う|対応|提供|支援|お応え|応じる|説明|お話し|お教え|教える|コメント|協力|お力になる)(?:する)?(?:こと)?(?:は|が|も|を)?(?:でき(?:ません|ない|かね)|いたしかね|しかね|致しかね|差し控え|控え|いたしません|しません)|(?:お断り|拒否|辞退)(?:し|いた|さ|申し)|(?:お答え|申し上げ|お応えし)(?:られ)?(?:ません|かねます)|お力になれません|ご遠慮")
_DECLINE_KO = re.compile("(?:도와|도울|답변|답할|답해|대답|제공|알려|처리|응할|말씀|설명|지원)[가-힣]{0,5}수(?:가|는)?없|거절(?:합|하|해)|답변하지않|응하지않|도와드리지못|답변드리지못|거부(?:합|하)")
DECLINES_DENSE = (_DECLINE_ZH, _DECLINE_JA, _DECLINE_KO)

#: Clauses around a refusal that give nothing of what was asked.
_FILLER_EN = re.compile(
    r"(?:oh |hm+ |well |so |and |but |yet |however |though |still |thus |also )*(?:(?:i am|im|we are|i m) (?:so |very |truly |really |deeply |terribly )?(?:sorry|afraid)\b.{0,40}|sorry\b.{0,40}|(?:my |our |please accept my )?(?:sincere |deepest )?apolog\w+\b.{0,40}|i (?:must )?apolog\w+\b.{0,40}|unfortunately|regrettably|sadly|alas|i regret\b.{0,40}|thanks?\b.{0,50}|thank you\b.{0,50}|as an? (?:ai|assistant|artificial|language|chat\w*|virtual|responsible|large)\b.{0,40}|(?:since |because |as )?(?:i am|im|i m) (?:only |just |merely )?an? (?:ai|assistant|artificial|language|chat\w*|virtual|large|machine|computer)\b.{0,40}|i (?:do |fully |can )?(?:understand|see|appreciate|know|hear|get|realize|realise|respect)\b.{0,60}|i hope\b.{0,50}|hope\b.{0,40}|(?:because|since|as|for) (?:it|this|that|i|they|such|my|the request|the topic)\b.{0,60}|at (?:this|the) (?:time|moment|point)|for (?:safety|legal|ethical|privacy|policy)\b.{0,40}|to be (?:honest|frank|clear|fair)|honestly|frankly|hm+|well|oh|no|nope|however|but|yet|nevertheless|please\b.{0,70}|is there (?:anything|something)\b.{0,60}|(?:can|may|could) i (?:help|assist)\b.{0,50}|let (?:me know|us)\b.{0,60}|feel free\b.{0,60}|if (?:you|there)\b.{0,60}|you (?:may|might|could|should) (?:want to |wish to |try |ask |consult |contact ).{0,50}|kindly\b.{0,50}|(?:i|we) (?:would|d) (?:be happy|be glad|suggest|recommend)\b.{0,60}|instead|perhaps\b.{0,50}|it (?:may|might|could) be (?:unsafe|harmful|dangerous|illegal)\b.{0,30})"
)
_FILLER_ZH = re.compile(
    "(?:(?:非常|很|十分|真的|真是|实在|深感|万分)*(?:对不起|抱歉|遗憾|不好意思|惭愧)|请?(?:您|你)?(?:见谅|谅解|原谅|体谅|理解|包涵)|恕我直言|坦白说|坦率地说|老实说|说实话|感谢.{0,12}|谢谢.{0,12}|(?:作为|身为|我是|我只是|因为我只?是|由于我只?是).{0,6}(?:助手|模型|人工智能|机器人|AI|ai|程序).{0,6}|(?:因为|由于|毕竟|鉴于).{0,24}|(?:希望|还望|敬请|望).{0,4}(?:理解|谅解|见谅|包涵|体谅).{0,4}|请.{0,4}(?:咨询|联系|询问|寻求|参考|查阅|另|换|改).{0,14}|(?:建议|您可以|你可以|不妨).{0,18}|我们?(?:换个|换一个|聊聊|谈谈|改).{0,12}|(?:还有|有)(?:什么|没有|其他|别的).{0,16}|(?:如果|如有|若).{0,24}|我(?:很)?(?:理解|明白|知道|懂得|尊重).{0,14}|目前|现阶段|不过|但是|但|然而|可是|只是|唉|嗯|呃|好的)"
)
_FILLER_DE = re.compile(r"(?:leider|es tut mir\b.{0,30}|tut mir\b.{0,30}|verzeihung|entschuldig\w+\b.{0,30}|ich bedaure\b.{0,40}|bedauerlicherweise|danke\b.{0,40}|vielen dank\b.{0,40}|als (?:ki|assistent\w*|sprachmodell|künstliche)\b.{0,30}|weil\b.{0,60}|da ich\b.{0,60}|ich (?:verstehe|hoffe|bitte)\b.{0,60}|bitte\b.{0,60}|kann ich\b.{0,40}|wenn\b.{0,60}|leider gilt|aber|doch|jedoch|ehrlich gesagt|gibt es\b.{0,40}|fragen sie\b.{0,40})")
_FILLER_ES = re.compile(r"(?:lo siento\b.{0,30}|lo lamento\b.{0,30}|lamento\b.{0,50}|lamentablemente|por desgracia|desgraciadamente|disculp\w+\b.{0,30}|perdón\b.{0,30}|perdona\b.{0,30}|gracias\b.{0,40}|como (?:ia|asistente|modelo|una? )\b.{0,40}|porque\b.{0,60}|ya que\b.{0,60}|espero\b.{0,50}|entiendo\b.{0,50}|comprendo\b.{0,50}|por favor\b.{0,50}|consult\w+\b.{0,50}|pero|sin embargo|hay algo\b.{0,40}|si (?:quieres|necesitas|desea)\b.{0,50}|sinceramente|pregunt\w+\b.{0,50})")
_FILLER_FR = re.compile(r"(?:(?:je suis |nous sommes )?(?:vraiment |sincèrement |profondément )?(?:désolée?s?|navrée?s?)\b.{0,40}|pardon\w*\b.{0,30}|excuse\w*\b.{0,40}|mes excuses\b.{0,30}|malheureusement|hélas|je regrette\b.{0,40}|merci\b.{0,50}|en tant qu\b.{0,50}|en tant que\b.{0,50}|je (?:comprends|sais|vous prie|ne suis qu)\b.{0,60}|(?:car|parce que|parce qu|puisque|comme)\b.{0,70}|veuillez\b.{0,60}|si (?:vous|tu)\b.{0,60}|sil (?:vous|te) plaît|mais|cependant|toutefois|pour des raisons\b.{0,50}|(?:puis je|nhésitez)\b.{0,60}|j ?espère\b.{0,50}|honnêtement)")
_FILLER_PT = re.compile(r"(?:sinto muito\b.{0,40}|lamento\b.{0,50}|desculp\w+\b.{0,40}|peço desculpas?\b.{0,40}|infelizmente|obrigad\w\b.{0,40}|como (?:uma? |assistente|modelo|ia)\b.{0,50}|porque\b.{0,60}|pois\b.{0,60}|espero\b.{0,50}|entendo\b.{0,50}|compreendo\b.{0,50}|por favor\b.{0,60}|se (?:você|quiser|precisar)\b.{0,60}|mas|porém|no entanto|posso ajudar\b.{0,40}|sinceramente)")
_FILLER_IT = re.compile(r"(?:mi (?:di)?spiace\b.{0,40}|scus\w+\b.{0,40}|chiedo scusa\b.{0,40}|purtroppo|sfortunatamente|grazie\b.{0,40}|come (?:assistente|modello|ia|intelligenza)\b.{0,50}|in quanto\b.{0,50}|perché\b.{0,60}|poiché\b.{0,60}|spero\b.{0,50}|capisco\b.{0,50}|comprendo\b.{0,50}|per favore\b.{0,60}|se (?:vuoi|vuole|hai|ha)\b.{0,60}|ma|però|tuttavia|posso aiutar\w+\b.{0,40}|sinceramente)")
_FILLER_NL = re.compile(r"(?:helaas|sorry\b.{0,40}|het spijt (?:me|mij)\b.{0,40}|mijn excuses\b.{0,30}|jammer genoeg|bedankt\b.{0,40}|als (?:ai|assistent|taalmodel)\b.{0,40}|omdat\b.{0,60}|want\b.{0,60}|ik (?:begrijp|hoop)\b.{0,50}|maar|toch|als (?:je|u)\b.{0,60})")
_FILLER_RU = re.compile(r"(?:к сожалению|увы|извин\w+\b.{0,40}|прост\w+\b.{0,40}|мне (?:очень )?жаль\b.{0,40}|сожалею\b.{0,40}|спасибо\b.{0,40}|как (?:ии|ассистент|языковая)\b.{0,40}|потому что\b.{0,60}|поскольку\b.{0,60}|так как\b.{0,60}|надеюсь\b.{0,50}|понимаю\b.{0,50}|пожалуйста\b.{0,50}|если\b.{0,60}|но|однако)")
_FILLER_JA = re.compile("(?:(?:大変|誠に|まことに|本当に)?(?:申し訳|すみません|すいません|恐れ入り|残念|ごめん|恐縮|失礼).{0,16}|(?:ai|私は|わたしは|当方は).{0,16}|.{0,24}(?:ため|ので|から)|ご(?:了承|理解|容赦|質問|要望).{0,12}|どうか.{0,12}|また(?:の|他).{0,20}|他に.{0,20}|(?:しかし|ですが|けれども|でも))$")
_FILLER_KO = re.compile("(?:(?:대단히|정말|매우)?(?:죄송|미안|유감|안타깝|아쉽).{0,12}|.{0,24}(?:때문에|때문입니다|므로|이라서)|(?:양해|이해).{0,12}|다른.{0,20}|(?:하지만|그러나|그렇지만)|저는.{0,14}|ai.{0,14})$")
FILLERS = (_FILLER_EN, _FILLER_DE, _FILLER_ES, _FILLER_FR, _FILLER_PT, _FILLER_IT, _FILLER_NL, _FILLER_RU)
FILLERS_DENSE = (_FILLER_ZH, _FILLER_JA, _FILLER_KO)

#: Labels before the question and before the answer of a stored pair; the first that opens the text decides.
PAIR_LABELS: tuple[tuple[re.Pattern, re.Pattern], ...] = tuple(
    (re.compile(rf"\s*(?:{a})", re.I), re.compile(b, re.I))
    for a, b in (
        (r"<\|?(?:user|human|question|prompt|instruction|im_start\|>user)\|?>", r"(?:</(?:user|human|question|prompt|instruction)>|<\|(?:end|im_end)\|>)?\s*<\|?(?:assistant|bot|answer|response|completion|model|im_start\|>assistant)\|?>"),
        (r"\[INST\]", r"\[/INST\]"),
        (r"#{2,}\s*(?:instruction|question|prompt|input|human|user|指令|问题|frage|pregunta)\s*[:：]?", r"(?:^|\n)\s*#{2,}\s*(?:response|answer|output|completion|assistant|回答|答案|回复|antwort|respuesta)\s*[:：]?"),
        (r"\*\*(?:question|q|user|human|prompt|问题|问|用户)\s*[:：]?\*\*\s*[:：]?", r"(?:^|\n)\s*\*\*(?:answer|a|assistant|response|答案|答|助手)\s*[:：]?\*\*\s*[:：]?"),
        (r"(?:question|q|human|user|prompt|instruction|input|client|customer|student|interviewer|frage|f|benutzer|nutzer|mensch|pregunta|p|usuario|cliente|问题|问|用户|提问|提问者|客户|学生|指令|输入)\s*[:：]", r"(?:^|\n)\s*(?:answer|a|assistant|bot|ai|model|response|output|completion|agent|teacher|reply|antwort|assistent|respuesta|r|asistente|答案|答|助手|回答|回复|助理|客服|老师|机器人|输出)\s*[:：]"),
    )
)
PAIR_END = re.compile(r"\s*(?:</(?:assistant|bot|answer|response|completion|model)>|<\|(?:end|im_end|endoftext)\|>|</s>)\s*$", re.I)
