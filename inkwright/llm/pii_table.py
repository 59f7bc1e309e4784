"""The labelled table of the tagger of personal information: passages with marked values, made by rule.

Nothing in it is taken from the texts that are tagged. Names are common public ones of many countries or are built letter by
letter; addresses, numbers and mail addresses are drawn from the forms that countries use; carrier lines are general ones, of
letters, forms, mails, reference lists, minutes and papers, in four languages. {name}, {email}, ... mark values, other braces
fill the rest. Lines and names fall into parts by number, so that a model fitted on some parts can be measured on another that
shares neither lines nor names with them. Size, seed and parts are parameters.
"""

from __future__ import annotations

import random

KINDS = ("name", "email", "phone", "id_number", "address")

# Common given and family names of many countries.
GIVEN = """James Mary Robert Linda Michael Susan David Karen William Nancy Thomas Emily Charlotte Oliver Amelia George Harriet Sean Niamh Callum Hans Greta Jürgen
Sabine Wolfgang Ingrid Matthias Jean Claire Philippe Élodie François Amélie Giovanni Chiara Luca Maria Carlos Lucía Diego Sofía João Beatriz Lars Astrid Søren Freja Mikko Aino Piotr
Agnieszka Jakub Zsófia László Dragan Milena Ivan Olga Dmitri Natalia Yusuf Fatima Omar Layla Arjun Priya Ravi Ananya Hiroshi Yuki Kenji Sakura Minh Linh Wei Jing Xiaoming Lihua Ahmed
Noor Kwame Amina Chidi Zanele Tariq Esther Noah Ruth Anne-Marie Jean-Luc Karl-Heinz Ana-Lucia Björn Zoë Renée José Siobhán Łukasz Nils""".split()
FAMILY = """Smith Johnson Brown Taylor Wilson Davies Evans Walker Wright Thompson Green Hughes Edwards Turner Parker Cooper Fitzgerald O'Brien McCarthy MacLeod Müller Schmidt Schneider
Weber Wagner Becker Hoffmann Schröder Dupont Moreau Lefèvre Girard Rousseau Rossi Esposito Bianchi Ricci García Martínez Gonzalez Hernández Silva Pereira Costa Hansen Johansson
Lindqvist Bergström Nieminen Kowalski Nowak Wójcik Nagy Kovács Petrović Popescu Ivanov Sokolova Volkov Yilmaz Khan Hussain Haddad Mansour Patel Sharma Gupta Iyer Tanaka Suzuki Yamamoto
Nakamura Nguyen Tran Zhang Wang Chen Liu Zhao Okafor Mensah Dlamini Abebe Levy Cohen Goldberg Smith-Jones Garcia-Lopez Meyer-Lansky""".split()
PARTICLES = ["van", "van der", "von", "de", "de la", "di", "del", "al-", "ten", "le"]
# Common Chinese family names, single and double, and characters of given names.
HAN_FAMILY = """王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤
温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫费卜冷晏席卫米柏
宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝闻沐""".replace("\n", "")[:190]
HAN_DOUBLE = "欧阳 上官 司马 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 夏侯 宇文 司徒 端木 司空 南宫".split()
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建国文辉力玲志海燕红梅鑫宇浩然子轩梓涵雨欣思远一诺佳怡晨曦俊凯博学礼安琪若溪云舟清扬望舒青松雪岚竹知行墨白星河临渊映川怀瑾嘉木"
# Kinds of streets, and words before them.
STREET = "Street Road Lane Avenue Drive Close Court Way Place Square Crescent Terrace Boulevard Hill Row Walk Grove Gardens Parkway Mews Bend Quay Rise Green View St. Rd. Ave. Blvd. Dr. St Rd Ave".split()
STREET_BASE = "Maple Oak Church Station Victoria King Queen Mill Park Bridge Castle Chestnut Cedar Lake River School Spring Market Meadow Forest Harbour Garden Abbey Windmill Orchard Vine Baker Downing Sunset Evergreen Fleet Rose".split()
STREET_FIRST = "Old Upper Lower North South East West New Great Little Saint High".split()
STRASSE = "straße weg gasse allee platz ring damm ufer hof steig graben strasse".split()
STRASSE_BASE = "Linden Bahnhof Schiller Goethe Garten Kirch Mühlen Berg Wald Rosen Haupt Schul Brunnen Birken Kastanien Sonnen Tal Markt Burg Feld".split()
RUE = ["rue de", "rue du", "rue des", "avenue de", "avenue du", "boulevard de", "place de", "chemin des", "impasse du", "quai de", "allée des", "rue", "cours"]
RUE_BASE = "Paix République Gare Moulin Tilleuls Écoles Victor-Hugo Lilas Château Fontaine Marché Pasteur Voltaire Liberté Vignes Prés".split()
TOWN = """Boston Leeds Bristol Dublin Glasgow Oxford Denver Austin Toronto Sydney Auckland Springfield Portland Geneva Lyon Lille Nantes Rouen Bordeaux Köln Bremen Leipzig Freiburg
Graz Zürich Basel Utrecht Ghent Aarhus Uppsala Turku Gdańsk Brno Szeged Porto Sevilla Torino Bologna Haifa Pune Kyoto Osaka Busan Hanoi Nairobi Accra""".split()
TOWN_END = ["ton", "ville", "burg", "by", "ford", "dale", "ham", "mouth", "field", "stadt", "hausen", "heim", "berg", "wick", "stead", " Ferry", " Hill", " Bay", " Springs", "-sur-Mer", "-en-Bresse"]
HAN_CITY = "北京市 上海市 广州市 深圳市 杭州市 南京市 成都市 武汉市 西安市 苏州市 青岛市 厦门市 长沙市 浙江省宁波市 广东省珠海市 四川省绵阳市 云南省大理市 天津市".split()
HAN_AREA, HAN_ROAD = "海朝西东南北江新武长安城黄河静虹鼓栖龙福云雨青白石湖山文明", "中解人建和平胜利新华延长复兴光复学院科技花园滨江湖山春秋云梧桐松柏星月文昌学府"
HOST = "mail example acme contoso physics library press journal alumni uni-mainz inria ox cam tsinghua pku mit northwind openlab datahub riverbank institute fastmail post chem bio maths-dept".split()
TLD = ".com .org .net .edu .io .info .de .fr .cn .ch .at .it .eu .co.uk .ac.uk .edu.cn .com.cn .edu.au .gov .example .test .invalid".split()

# Carrier lines with values, one a line; | stands for a line break or a comma.
LINES = """\
For questions about the data please contact {name} at {email} or {phone}.
Please direct all enquiries to {name} ({email}).
{name}, Department of Physics, {address}
Principal investigator: {name}; tel {phone}; fax {phone}
Author for correspondence: {title} {name}. Email: {email}
*Corresponding author. E-mail address: {email} ({name}).
{title} {name} confirmed by phone ({phone}) that the samples had arrived.
{title} {name} may be phoned on {phone}.
You can reach {title} {name} on {phone} after noon.
Her social security number is {id_number}.
SSN: {id_number}
The applicant, {name}, holds passport number {id_number}.
Passport No. {id_number}, issued to {name} in May.
Passport {id_number} and the private address {address} are on file.
ID card: {id_number}; name: {name}; phone: {phone}
National ID number {id_number} belongs to {name}.
(Entered by {name}; citizen number {id_number}.)
Subject 12: {name} / {id_number} / {phone}.
Driver's licence {id_number} was copied by mistake.
National insurance number: {id_number}
Tax identification number {id_number}, {name}
Identity document {id_number} expires next year.
Deliver to: {name}|{address}
I live at {address}.
The office moved to {address} last spring.
Home address: {address}
Please post the parcel to {name}, {address}.
Return the form by mail to {address} before Friday.
Come to {address} for the workshop.
Send a copy to {name}, {address}, and call {phone}.
{name} <{email}> wrote:
From: {name} <{email}>|To: {name} <{email}>|Subject: revised draft
Name: {name}|Address: {address}|Phone: {phone}|Email: {email}
Name|{name}|{address}|Tel. {phone}
{name}, {name} and {name} contributed equally.
{name} and {name} are joint first authors.
The authors are grateful to {name} for comments, and to {name} for help with the figures.
We are indebted to {name} and to {name} for reading early drafts.
Thanks to {name}, {name}, and {name}.
Supervised by Professor {name}
Interview with {name}, recorded in March.
[{n}] {name}, {name}: A survey of the field, 2019.
[{n}] {name}, and {name}. An annotated bibliography. Tech report.
[{n}] {name}, {name}, and {name}. On the limits of the method.
{n}. {name}, {name} & {name} (2016). The long road to agreement.
{name}, {name}, {name}, and {name}. 2021. In Proceedings of the workshop.
Signed, {name}
Kind regards,|{name}|{phone}
cc: {name}
Edited by {name} and {name}
Proofread: {name}
Text me on {phone} or write to {email}
Mobile {phone}, office {phone}
Ring {phone} if the door is locked.
Dial {phone} before Monday to register.
Our hotline is {phone}.
Reviewer 2 ({name}) asked for a larger sample.
According to {name}, the survey was late.
{name} approved the budget on Tuesday.
{name} joined the group in 2018 and left a year later.
as {name} told us
Questions? Mail {email}.
Reports go to {email} until June.
The account {email} was replaced by {email}.
Contact the help desk under {email}
E-mail: {email}; web: www.site.example
email {email}
mailto:{email}
Ask {name} <{email}> for the password of the archive.
The questionnaire asks {name} (born 1970, ID {id_number}) where he lives: {address}.
Kontakt: {name}, {email}
Bitte wenden Sie sich an {name} unter {phone}.
Fragen beantwortet {name} gern ({email}).
Betreut von {title} {name}.
Anschrift: {address}
Frau {name} wohnt in {address}.
Die Sendung geht an {name}, {address}.
Wir danken {name} und {name} für wertvolle Hinweise.
Mobil: {phone}, Büro: {phone}
Telefon {phone}, E-Mail {email}
Personalausweis Nr. {id_number}, ausgestellt auf {name}
Die Steuernummer {id_number} bleibt vertraulich, sagt {name}.
Gegengelesen von {name}.
Verantwortlich: {name}, {address}
Contact : {name}, {email}
Joindre {name} au {phone}.
Pour tout renseignement, écrivez à {email} ou appelez le {phone}.
Adresse postale : {address}
Nous remercions {name} et {name} de leur aide.
Numéro de sécurité sociale : {id_number}
Carte d’identité n° {id_number} au nom de {name}
Le paquet est envoyé à {name}, {address}.
Version corrigée par {name}.
Responsable : {name}, tél. : {phone}, courriel : {email}
Les documents seront déposés au {address}.
联系作者{name}（{email}）
联系人{name}，手机号{phone}
本文由{name}与{name}合作完成。
指导教师：{name}
姓名：{name}；电话：{phone}；身份证：{id_number}
{name}，女，身份证号码{id_number}，住{address}。
电话：{phone}
请拨打{phone}或者写信到{email}
如需帮助，请联系{name}，电话是{phone}。
微信同号 {phone}
护照号码{id_number}的持有人是{name}。
系统中保存的身份证号是{id_number}。
家住{address}。
收货地址：{address}，收货人：{name}
请将样书寄往{address}，{name}收。
通信地址：{address}
致谢：感谢{name}、{name}的帮助。
作者衷心感谢{name}提出的修改建议。
（整理：{name}）
校对者{name}
译：{name}
记者{name}报道
据{name}介绍，项目已经完成。
{name}教授的团队发布了数据。
邮箱：{email}
来信请寄 {email} 。""".splitlines()

#: Lines whose words are made up but for a cue, so that values are also known without a phrase that one has met.
OPEN = """\
{G} {g} {cue_person} {name} {g} {g}.
{G} {cue_person} {g} {name}, {g} {g} {g}.
{cue_person}: {name}, {g}.
({cue_person} {name}; {g} {g}.)
{G} {cue_person} {name} {g} {name} {g} {g} {g}.
{G} {cue_person} {name}, {name}, {name}.
{G}, {title} {name}, {g} {g} {g}.
{G} {title} {name} {g} {g}.
{G} {g} {title} {name}.
{name} {cue_said} {g} {g} {g}.
{name} {cue_said} {g} {g}, {cue_said} {name}.
{G} {g} {g} {g}, {cue_said} {name}.
{G} {g} {g} by {name}, {g} {g}.
{G} {g} {g} von {name}. {G} {g} par {name}.
{G} {g} {name} and {name} {g} {g} {g}.
{G} {cue_person} {name}, {name} and {name} for {g} {g}.
{G} {cue_person} {name} and {name} for {g} {g} {g}. {G} {g}.
{name}, and {name}. {W} {g} {g} {g}.
{G} {name}, {name}, and {name}: {g} {g}.
{zs}{han_person}{name}对{zs}的{zs}。
{han_person}{name}、{name}与{name}对{zs}{zs}。
{G} {g} {g} {name} {g} {g} {g}.
{G} {g} {name} {g} {g} {g} {g}.
{G} {g} {g} {name}, {g} {g} {g} {g}.
{G}, {name} {g} {g} {g}.
{G} {g} {g} {g} {name}.
{name} {g} {g} {g}, {g} {g}.
{G} {g} {name} and {name} {g} {g}, {g} {g}.
{G} {g} {name}, {g} {address}.
{G} {g} {g} {address} {g} {g} {g}.
{zs}{zs}{name}，{zs}。
{name}{han_person}{zs}了{zs}。
{zs}的{name}，{han_phone}{phone}。
{G} {g} {name} {g} {g} {name}, {g} {g}.
{G} {g} {name} {g} {address} {g}.
{name}, {name} {g} {name} {g} {g}.
{G} {g} {g} {name} {g} {phone}.
{name} <{email}> {g} {g}
{name}, {email}, {g}
{name}|{address}|{g} {phone}
{G} {g} {cue_address} {name}, {address}.
{G} {g} {g} {g} {name}, {address}.
{G} {g} {g} {name} ({email}).
{G} {g} {g} {name}, {cue_id} {id_number}.
{G} {g} {g} {name}, {cue_phone} {phone}.
{G} {g} {cue_address} {address}.
{cue_address}: {address}
{G} {g} {cue_address} {g} {address} {g} {g}.
{G} {cue_address} {g} {g} {address}.
{G} {g} {cue_phone} {phone}; {cue_phone}: {phone}.
{G} {cue_phone} {g} {phone} {g} {g} {g}.
{G} {g} {cue_phone} {phone}, {cue_mail} {email}.
{cue_phone} {phone}
{cue_phone}: {phone} ({g} {g})
{G} {g} {g} {cue_phone} {g} {g} {phone} {g} {g}.
{G} {g} {cue_id} {id_number} {g} {g}.
{cue_id}: {id_number}
{cue_id} no. {id_number}; {g}
{G} {cue_id} {g} {id_number}, {g} {g}.
{G} {cue_id} {g} {g} {id_number}.
{G} {cue_id} {cue_id} {g} {id_number} {g}.
{name}, {cue_id} {id_number}, {g} {g}.
{name} / {id_number} / {phone}
{G} {g} {cue_mail} {email} {g} {g} {email}.
{G} {g} {g} {email} {g}.
{name}; {name}; {name}
[{n}] {name}, {name}. {G} {g} {g}, {g} {g}.
[{n}] {name}, and {name}. {W} {g} {g} {g}.
{name} and {name} ({y}). {W} {g} {g}.
{zs}{han_person}：{name}，{zs}。
{zs}{han_person}{name}{zs}。
（{han_person}：{name}）
{han_person}{name}的{zs}{n}{zs}。
{zs}，{han_person}{name}。
{zs}{han_phone}：{phone}，{zs}{han_mail}：{email} {zs}
{zs}{han_phone}{phone}{zs}
{zs}{han_address}：{address}。
{zs}{han_address}{address}，{zs}{name}。
{zs}{han_id}为{id_number}，{zs}。
{han_id}：{id_number}
{zs}{han_id}{zs} {id_number} {zs}
{zs}{han_person}{name}和{name}{zs}。""".splitlines()

# Lines without a value, though with what resembles one.
PLAIN = """\
The {F} inequality gives a bound for {n} samples.
{F} et al. ({y}) report {n}.{n} percent.
We follow {F} and {F} ({y}) and use the {F} kernel.
({F}, {y}; {F}, {y})
{F}'s theorem holds for all {n} cases; a {F}-type estimate follows.
A {F} process with {F}–{F} corrections.
In the {F} data set, {n} of {n} rows are blank.
See {F} [{n}] for the proof.
See doi 10.{d4}/{w}.{y}.{d3} and https://doi.org/10.{d4}/{d6}.
ISBN 978-{n}-{d5}-{d3}-{d1}, ISSN {d4}-{d4}
arXiv:{d4}.{d5}v{d1} was posted on {y}-0{d1}-1{d1} at 12:{d2}:{d2}.
arXiv {d4}.{d5} and preprint {d4}.{d4}
Grant no. DMS-{d7} and contract {A}{A}-{d4}/{d2} supported this work.
Grant {A}-{d2}/{d3} funded {n} runs.
Ticket {d8} was closed; build {d1}.{d2}.{d1}-{d3} failed.
Commit {d7}, revision {d8}, commit {hex}
Random seed {d8}, learning rate 0.000{d1}, {d5} steps
Invoice {d8} and order {d11} of {y}
Parcel number {d12} is on its way.
The server 10.{d2}.{d1}.{d3} answered after {d3} ms on port {d4}.
{d40}
The corpus has {d2},{d3},{d3} tokens in {d3} files.
Pages {n}-{n}, vol. {n}, no. {n}, {y}
We met in {town}, near the old market.
The workshop took place in {town}, {town} and {town}.
Address the remarks in Section {n}.{n} and Appendix {A}.
look at dot products; at dot level
@article{key{y}, title = {A study}, year = {{y}}}
Nobody answered the telephone, and letters came back unopened.
Each street in {town} has its own character, says the guide book.
A road of {n} km links {town} with {town}; the avenue is lined with trees.
The court heard {n} cases; the drive to {town} took {n} hours.
Mail servers, routers and name tables are described in chapter {n}.
Every caller of this function must pass {n} arguments by name.
Memory address 0x{hex} holds {n} bytes; a page fault follows at {d6}.
An annotation such as @Override or @param is not text.
ndcg@{n}, top@{d1} and f1@0.{d1} were computed
Bug {d6} duplicates bug {d5}; see merge request !{d4}
The log has {d1},{d3},{d3} lines in {d2} parts.
Can't, won't, isn't and shouldn't; I've, you'd
{M} or {M} was chosen because {M} {w} {w}, said the committee.
Users of {M} and {M} {w} {w} more often than users of {M}.
In {M}, {w} {w} follows {w}, and {M} {w} {n} {w}.
Both {M} and {M}-{d1} {w}; neither {M} nor {M} {w} {w}.
Replacing {M} by {M} costs {n} {w}, with {M} at rest.
Without {M}, {w} {w} {w}; with {M}, it {w} at once.
To {w} {M} is to {w} the {w} of the {w} {w}.
Why does {M} {w} {w} when {w} {w} has {n} {w}?
Suppose that {w} {w} {w}. Hence {w} is below {n}.
{W} {w}, working paper.
{W} of {w}, lecture notes.
Early remarks on {w} {w}, circulated privately.
电子邮件系统、街道地图与通信协议见第{n}章。
号码池共有{d4}个，区号表位于附录{n}。
本节讨论{h}，并介绍{h}的来历；读者可以跳过{h}。
{M}把{h}变成{h}，再由{M}输出。
这里的{h}取自{M}，共有{n}项，{h}除外。
为何{h}优于{h}？因为{h}更快，而且{h}较少。
{z}，{z}。{z}{n}{z}，{z}。
{z}与{z}{h}，{z}在第{n}{z}。
{z}{h}（{n}）{z}，{z}需要{n}{z}。
{z}：{z}{h}{z}。{z}、{z}与{z}。
{h}的{z}在{M}上{z}{n}.{n}{z}。
A {M} {w} {w} the {w}; under {M} it {w}.
If {M} {w} the {w}, {w} {w}. On {M}, {w} {w} {w}.
{w} {w} {w} on {M}-{A}; {w} {w} on {M}-{A} {w}.
With {w} {w}, {M}-{A} {w} {n} {w}. Under {w}, {M} {w}.
Read on {y}-0{d1}-1{d1} {d2}:{d2}:{d2}; updated {d2}/{d2}/{y} and {d2}.0{d1}.{y}.
{M}, an {w} {w}, {w} {w} at low cost and at high {w}. At rest, {w} {w}.
{W} {w} at {w} {w}. {W} {w}, at {n} {w}, {w}.
作者认为{h}很重要，编者则强调{h}。
注意{h}和{h}的区别，见图{n}与表{n}。
{G} {M} {g} {g} {w} {g}.
{G} {M} {w} {w}; {g} {M} {g} {w}.
{W} {M} {w} {g} {g}. {W} {M} {g} {w}.
{G} {g} by {M}, {cue_said} {g}. {M} {cue_said} {w} {g}; by {M} or with {M}.
The {F} {w}, a {F} {w} and {F}'s {w} {cue_said} {g}.
{zs}使用{M}{zs}，在{M}-{A}上{zs}{n}{zs}。训练{M}{h}，{M}-{A}{h}。
{han_person}{zs}{h}，{han_person}{z}了{z}。
Unlike {M}, {M} {w} {g}. Like {M}, {w} {w}. Through {M} or via {M}, {w} {w}.
A {M} {w}, an {M} {w} and the {M} {w} {w} {g}.
{cue_number} {d7}, {cue_number} {d8} {g} {cue_number} {d6}.
{cue_number} {d3}-{d3} {g} {g}; {cue_number} {d4}-{d4}; {cue_number} {A}{d5}
{zs}{han_number}{d8}，{han_number}{d6}{zs}。
Table of Contents
Data Availability Statement
Supplementary Material for Section {n}
Deep Residual Learning for Image Recognition
Attention Is All You Need
Proceedings of the {y} Conference on Machine Learning, {town}
University of {town}, Institute of Applied Physics
New York and Los Angeles are large cities.
Monte Carlo, Markov Chain and Nash Equilibrium are terms.
The Gaussian Process beats the Random Forest on {M} {n}.
{M} was trained with Adam on {n} cards; {M} was not.
{M}, {M} and {M} are compared with {M}-{n}.
{M} {w} the {w} {w}, while {M} {w} only {w}.
If {M} is removed, {w} {w} drops by {n}.{n} points.
Note on {w} {w}: {M} {w} {w}.
On the {w} of {w} {w}, technical report.
Figure {n}: {w} {w} of the {M} {w}.
Figure {n}. The {W} {W} before and after {w}.
Table {n} shows {w} {w} for {M} and {M}.
{W} {W}: {w} {w} {w}
{W} {w} {w} and {w}. {W} {w} the {w} {w} of {w}.
The {w} {w} of {M} has {n} {w} {w}, which {w} on {M}.
However, {M} {w} {w}. Therefore the {w} {w} is {w}.
# {W} {W}
## {d1}.{d1} {W} {w}
Keywords: {w} {w}, {w}, {M}
See $\\alpha_{k} \\le \\sum_{i=1}^{n} x_i^{2}$ and \\cite{{w}{y}}.
\\begin{figure}[h]\\includegraphics{{w}.pdf}\\end{figure}
def {w}(x, n={n}): return x[{n}:] + {d3}
for i in range({n}): total += {w}[i]
<p class="{w}">{w}&nbsp;{w}</p> &lt;br&gt;
{"id": {d5}, "page": {n}, "ok": true, "label": "{w}_{w}"}
⟦{d1}⟧ {w} ⟦{d1}⟧ {w} <|sep|> {w}
😀 {w} {w} 🎉🎉 {n}%
Der {w} Ansatz prüft {n} Werte, die Tabelle {n} zeigt alle Fälle. Auf Seite {n} fehlt die Legende.
Das Modell {M} übersetzt {n} Sätze; die Fußnoten bleiben gleich. Für Seite {n} sinkt der Wert auf {n} Prozent.
In {town} wurde die Straße gesperrt. Die Adresse fehlt noch, ein Telefon gibt es nicht.
Die Arbeit von {F} ({y}) nennt {n} Gründe. Kapitel {n} fasst zusammen.
Le tableau {n} montre {n} cas. Les légendes de la page {n} sont conservées, mais la colonne de droite est vide.
Le modèle {M} traite {n} phrases. À {town}, la rue principale est fermée.
La méthode de {F} ({y}) reste la plus simple; l’étude compte {n} mesures.
我们在{M}数据集上训练{h}，共{n}轮，学习率为0.00{d1}。
第{n}页的{h}没有编号，合同编号为{d8}，工单{d6}已关闭。
{h}方法由{h}组成，包括{h}、{h}和{h}。
订单号{d11}，流水号{y}{d4}，版本{d1}.{d2}
तालिका और परीक्षण, 표와 시험, جدول واختبار, ตารางทดสอบ, проверка таблицы""".splitlines()

# Words of running text.
WORDS = """sparse dense hidden robust linear local global random stable shared deep wide mixed causal neural visual graph token feature layer margin kernel prior policy reward query sample
cluster memory model method table figure caption formula page block border line column corpus phrase label score error loss rate bound signal noise image text speech track depth motion
improves reduces predicts ignores replaces learns aligns slowly often mostly again earlier together pipeline schedule budget profile index header footer layout marker section paragraph""".split()
HAN_WORDS = "模型 方法 数据 特征 注意力 公式 版面 误差 表格 图像 文本 语音 编码 解码 训练 推理 检索 对齐 损失 梯度 矩阵 概率 贝叶斯 阈值 噪声 边界 样本 标签 权重 卷积 残差 记忆 策略 奖励 段落 标题 参考文献 页码 术语 翻译 校验 鲁棒 稀疏 线性 局部 全局".split()
TITLES = ["Dr.", "Prof.", "Mr", "Mrs.", "Ms", "Dr", "Professor", "Prof. Dr.", "Herr", "Frau", "M.", "Mme"]


# Words that announce a value of a kind, that number something else, and that only hold sentences together.
CUES = {
    "phone": "phone telephone tel mobile cell cellphone fax call calls ring dial hotline reach reached whatsapp sms telefon mobil handy rufnummer fon anruf durchwahl téléphone tél portable appeler appelez joindre",
    "id": "passport passports identity identification ssn security insurance citizen licence license nid dni nie personalausweis ausweis ausweisnummer ausweisnr reisepass steuernummer identité passeport sociale",
    "address": "address addresses home visit visiting live lives ship shipped send sent post posted deliver delivered located anschrift adresse wohnt wohnhaft domicile épreuves",
    "mail": "email e-mail mail mailto mails courriel gmail login mailbox",
    "person": "author authors editor editors reviewer reviewers translator supervisor correspondence contact thank thanks grateful signed written proofread checked read by kontakt ansprechpartner betreut verfasser gegengelesen dank responsable relu remercions auteur by von par with",
    "said": """said says say wrote writes signed signs agreed agrees told asked asks replied reported reports noted thinks thought argued explained approved joined left met lives works confirmed answered added
        holds moved called sent schrieb schreibt sagte sagt meint meinte fragte dankt unterschrieb antwortete wohnt dit écrit signé répond explique habite""",
    "title": "dr prof professor mr mrs ms miss sir herr frau mme mlle doktor docteur",
    "number": "grant ticket issue commit order invoice isbn issn doi arxiv preprint version build seed page pages figure fig table section chapter equation eq vol volume no step steps epoch layer layers seite tabelle abbildung tableau chapitre grants contract revision bug",
    "glue": """a an the this that these those in on at of to for from without within unlike like via across through against about per except into over under between after before during if when while where why how what which who whose because although since unless as than whether whereas then and or nor but
        so yet not no is are was were be been being has have had do does did can could may might must shall should will would we you they he she it our your their its his her all any both each every either neither some such only also
        however therefore thus hence moreover given let see note there here der die das ein eine und oder ist sind mit ohne für von im am auf aus bei nach durch le la les un une des et ou est sont avec sans pour par dans sur""",
}
# The same for pairs of Chinese characters.
HAN_CUES = {
    "phone": "电话 手机 致电 拨打 来电 座机 传真 热线", "id": "身份 证件 证号 护照 件号", "address": "地址 寄至 寄往 寄到 家住 住址 住在 位于 送至 送到", "mail": "邮箱 邮件 信箱 电邮",
    "person": "作者 译者 编者 校对 审校 审稿 感谢 致谢 联系 系人 姓名 收件 件人 导师 老师 教授 记者 编辑 笔者 署名 翻译 整理", "number": "编号 订单 合同 工单 版本 表格", "glue": "我们 他们 因为 所以 但是 如果 或者 以及 这个 那个 可以 没有",
}
CUE_NAMES = ["", *CUES]
# Frequent Chinese characters, for running text.
HAN_COMMON = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运"


def part_of(items: list, part: int, parts: int) -> list:
    """The items whose number falls into `part` of `parts`; all for parts of 1."""
    return items[part::parts]


#: Shares of the three kinds of lines.
MIX = [0.3, 0.38, 0.32]


class Maker:
    """Draws values and fillers; `keep` says which of `parts` the lists give."""

    def __init__(self, r: random.Random, keep: list[int], parts: int):
        pick = lambda items: [x for p in keep for x in part_of(list(items), p, parts)]
        self.r, self.lines, self.plain, self.open = r, pick(LINES), pick(PLAIN), pick(OPEN)
        self.given, self.family, self.han_family, self.double = pick(GIVEN), pick(FAMILY), pick(HAN_FAMILY), pick(HAN_DOUBLE)
        self.town, self.base, self.strasse, self.rue = pick(TOWN), pick(STREET_BASE), pick(STRASSE_BASE), pick(RUE_BASE)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def invent(self, low: int = 1, high: int = 3) -> str:
        """A word by syllables, so that words can't be learned by heart."""
        r = self.r
        heads = "b c d f g h j k l m n p r s t v w z br cl dr fl gr kr pl qu sh st th tr wh sch".split()
        tails = ["", "", "n", "l", "r", "s", "m", "ck", "nd", "rt", "ll", "x", "ng", "th"]
        out = "".join(r.choice(heads) + r.choice(["a", "e", "i", "o", "u", "ei", "ie", "oa", "au", "y", "é", "ö", "ú"] if r.random() < 0.15 else list("aeiou")) + r.choice(tails) for _ in range(r.randint(low, high)))
        return out.capitalize()

    def word(self) -> str:
        return self.r.choice(WORDS)

    def family_name(self) -> str:
        r = self.r
        x = r.random()
        one = self.invent(1, 3) + r.choice(["", "", "son", "sen", "ski", "elli", "ova", "mann", "well", "ford", "by", "escu", "ez", "ier", "wood"]) if x < 0.55 else r.choice(self.family)
        if x > 0.94:
            return f"{r.choice(PARTICLES)} {one}".replace("- ", "-")
        return f"{one}-{self.invent(1, 2)}" if 0.45 < x < 0.55 else one

    def given_name(self) -> str:
        r = self.r
        one = self.invent(1, 3) + r.choice(["", "", "a", "el", "ine", "o", "is"]) if r.random() < 0.5 else r.choice(self.given)
        return f"{one}-{self.invent(1, 2)}" if r.random() < 0.1 else one

    def name(self) -> str:
        r = self.r
        if r.random() < 0.25:
            return self.han_name()
        g, f = self.given_name(), self.family_name()
        i = r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ") + "."
        j = r.choice("ABCDEFGHIJKLMNOPRSTW") + "."
        return r.choice([f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {i} {f}", f"{i} {f}", f"{i} {j} {f}", f"{f}, {g}", f"{f}, {i}", f"{f}, {i} {j}", f"{f} {g}", f"{f.upper()} {g}", f"{g} {f}".upper(), f"{i}{j} {f}"])

    def han_name(self) -> str:
        r = self.r
        f = r.choice(self.double) if r.random() < 0.15 else r.choice(self.han_family) if r.random() < 0.8 else chr(r.randint(0x4E00, 0x9FA5))
        one = lambda: r.choice(HAN_GIVEN) if r.random() < 0.5 else chr(r.randint(0x4E00, 0x9FA5))
        return f + "".join(one() for _ in range(r.choice([1, 2, 2, 2])))

    def email(self) -> str:
        r = self.r
        plain = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalpha()) or "x"
        g, f = plain(self.given_name()), plain(self.family_name())
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}.{f}", f"{g}{f}", f"{f}+{self.word()}", f"{g}-{f}", f"{g}{self.digits(2)}", f"{g[0]}{f[:6]}", f"{f}{self.digits(1)}", f, g, self.word(), f"{g[0]}{self.digits(5)}"])
        host = r.choice(["", "", "", "mail.", "cs.", "lab.", "dept.", "students.", "inf.", "math.uni."]) + (r.choice(HOST) if r.random() < 0.4 else plain(self.invent(1, 3)) + r.choice(["", "", "-" + self.word()])) + r.choice(TLD)
        x = r.random()
        if x < 0.5:
            out = f"{local}@{host}"
        elif x < 0.58:
            out = f"{local} @ {host}"
        elif x < 0.64:
            out = f"{local}＠{host}"
        else:
            at = r.choice(["(at)", " (at) ", "[at]", " [at] ", " at ", " AT ", "{at}", " [@] ", "(a)", "【at】", "&#64;"])
            dot = r.choice([".", ".", " dot ", "[dot]", " [dot] ", "(dot)", " DOT "])
            out = local + at + host.replace(".", dot)
            if r.random() < 0.1:
                out = local.replace(".", dot) + at + host.replace(".", dot)
        if r.random() < 0.1:
            out = out.upper()
        if r.random() < 0.06:
            k = r.randint(1, len(local))
            out = out[:k] + r.choice("​­⁠‍") + out[k:]
        return out

    def groups(self, total: int, sep: str, low: int = 2, high: int = 4) -> str:
        out = []
        while total > 0:
            k = min(total, self.r.randint(low, high))
            k = total if total - k < 2 else k
            out.append(self.digits(k))
            total -= k
        return sep.join(out)

    def phone(self) -> str:
        r, d = self.r, self.digits
        sep = r.choice([" ", "-", ".", " ", "-"])
        cn = "1" + r.choice("23456789") + d(1)
        out = r.choice([
            lambda: f"+{r.randint(1, 998)}{sep}{self.groups(r.randint(7, 11), sep)}", lambda: f"+{r.randint(1, 998)}{d(r.randint(7, 11))}", lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}{sep}{d(4)}",
            lambda: f"+{r.randint(20, 99)} (0){d(2)}{sep}{self.groups(7, sep)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}{sep}{d(3)}{sep}{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(4)} {d(4)}",
            lambda: f"00{r.randint(1, 998)} {self.groups(r.randint(7, 10), ' ')}", lambda: f"0{d(r.randint(2, 4))}/{self.groups(r.randint(6, 8), ' ')}", lambda: f"0{d(r.randint(2, 4))} {self.groups(r.randint(6, 8), ' ')}", lambda: f"(0{d(r.randint(2, 4))}) {self.groups(r.randint(6, 8), ' ')}",
            lambda: sep.join(["0" + d(1)] + [d(2) for _ in range(4)]), lambda: cn + d(8), lambda: f"{cn}{sep}{d(4)}{sep}{d(4)}", lambda: f"0{d(2)}-{d(8)}", lambda: f"0{d(3)}-{d(7)}", lambda: f"（0{d(2)}）{d(8)}",
            lambda: f"{r.choice(['+86', '(+86)', '+86 ', '(+86) ', '+86-', '0086 '])}{cn}{r.choice(['', ' ', '-'])}{d(4)}{d(4)}", lambda: f"{r.choice(['+86', '(+86)', '+86 ', '+86-'])}0{d(2)}-{d(8)}", lambda: f"(+{r.randint(1, 99)}){self.groups(r.randint(8, 10), sep)}",
        ])()
        return out + r.choice([f" ext. {d(2)}", f" x{d(3)}", f"转{d(3)}", f" ext {d(4)}"]) if r.random() < 0.08 else out

    def id_number(self) -> str:
        r, d = self.r, self.digits
        a = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        return r.choice([
            lambda: d(6) + r.choice(["19", "20"]) + d(2) + f"{r.randint(1, 12):02}{r.randint(1, 28):02}" + d(3) + r.choice("0123456789X"), lambda: d(17) + r.choice("0123456789Xx"), lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}",
            lambda: f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", lambda: f"{a(2)}{d(6)}{a(1)}", lambda: f"{d(8)}-{a(1)}", lambda: f"{d(8)}{a(1)}", lambda: f"{a(1)}{d(7)}{a(1)}", lambda: f"{a(1)}-{d(7)}-{a(1)}", lambda: f"{a(1)}{d(8)}", lambda: f"{a(2)}{d(7)}",
            lambda: f"{a(2)} {d(7)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", lambda: d(11), lambda: d(9), lambda: f"{a(1)}{d(3)}-{d(4)}-{d(4)}",
        ])()

    def town_name(self) -> str:
        r = self.r
        if r.random() < 0.4:
            return r.choice(self.town)
        return r.choice(["", "", "", "Port ", "Bad ", "Saint-", "New ", "Little ", "Upper "]) + self.invent(1, 2) + r.choice(["", "", *TOWN_END])

    def street_name(self) -> str:
        r = self.r
        base = r.choice(self.base) if r.random() < 0.5 else self.invent(1, 3)
        return (r.choice(STREET_FIRST) + " " if r.random() < 0.25 else "") + base + (" " + r.choice(STREET_BASE) if r.random() < 0.15 else "") + " " + r.choice(STREET)

    def address(self) -> str:
        r, d = self.r, self.digits
        n = str(r.randint(1, 400)) + (r.choice("abcABC") if r.random() < 0.12 else "")
        town = self.town_name()
        x = r.random()
        if x < 0.25:
            h = lambda s, k: "".join(r.choice(s) for _ in range(k))
            han = lambda k: h(HAN_AREA, k) if r.random() < 0.6 else "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(k))
            city = r.choice(HAN_CITY) if r.random() < 0.5 else han(2) + "市"
            gap = " " if r.random() < 0.1 else ""
            return gap.join([city + han(r.choice([1, 2])) + r.choice("区县区"), (h(HAN_ROAD, 2) if r.random() < 0.6 else han(2)) + r.choice(["路", "街", "大道", "巷", "大街", "东路", "胡同"]), f"{r.randint(1, 300)}号" + r.choice(["", "", f"{r.randint(1, 30)}楼", f"{r.randint(1, 9)}栋{r.randint(100, 999)}室", f"-{r.randint(1, 9)}", f"{r.randint(1, 9)}单元{r.randint(100, 999)}"])])
        if x < 0.43:
            base = r.choice(self.strasse) if r.random() < 0.5 else self.invent(1, 2)
            street = r.choice([base + r.choice(STRASSE), base + r.choice(STRASSE), f"{r.choice(['Am', 'Im', 'An der', 'Unter den', 'Zum', 'Auf dem'])} {base}", f"{base}er Straße", f"{r.choice(['Alte', 'Neue', 'Lange'])} {base}{r.choice(STRASSE)}"])
            return f"{street} {n}" + r.choice([f", {d(5)} {town}", f", {d(4)} {town}", f"|{d(5)} {town}", f", D-{d(5)} {town}", ""])
        if x < 0.55:
            base = r.choice(self.rue) if r.random() < 0.5 else self.invent(1, 2)
            return f"{n}{r.choice(['', ',', ' bis,'])} {r.choice(RUE)} {base}" + r.choice([f", {d(5)} {town}", f"|{d(5)} {town}", ""])
        code = r.choice([f" {d(5)}", f", {r.choice('ABCDEFGHKLMNPSTW')}{r.choice('ABCDEFGHKLMNPSTW')} {d(5)}", "", "", f" {r.choice('BCEGLMNSW')}{d(1)} {d(1)}{r.choice('ABDE')}{r.choice('GHJX')}"])
        unit = r.choice(["", "", "", "", f"Flat {r.randint(1, 30)}, ", f"Apt. {r.randint(1, 30)}{r.choice('AB')}, ", f"Apartment {r.randint(1, 90)}, ", f"Room {d(3)}, ", f"Unit {r.randint(1, 30)}, ", f"Suite {d(3)}, ", f"Floor {r.randint(1, 30)}, "])
        out = unit + f"{n} {self.street_name()}" + r.choice(["", f", {town}{code}", f", {town}{code}", f"|{town}{code}", f", {town}"])
        return out.upper() if r.random() < 0.08 else out

    def fill(self, key: str) -> str:
        r = self.r
        if key in KINDS:
            return getattr(self, key)()
        if key[0] == "d" and key[1:].isdigit():
            return self.digits(int(key[1:]))
        if key[:4] in ("cue_", "han_"):
            one = r.choice((CUES if key[:4] == "cue_" else HAN_CUES)[key[4:]].split())
            return one.capitalize() if r.random() < 0.3 else one
        return {
            "n": lambda: str(r.choice([r.randint(0, 9), r.randint(10, 99), r.randint(100, 999)])), "y": lambda: str(r.randint(1950, 2026)), "A": lambda: r.choice("ABCDEFGHKLMNPQRSTXYZ"),
            "w": self.word, "W": lambda: self.word().capitalize(), "h": lambda: "".join(r.choice(HAN_WORDS) for _ in range(r.choice([1, 1, 2]))), "F": lambda: self.family_name() if r.random() < 0.9 else r.choice(HAN_FAMILY),
            "z": lambda: "".join(r.choice(HAN_COMMON) for _ in range(r.randint(2, 9))), "zs": lambda: "".join(r.choice(HAN_COMMON) for _ in range(r.randint(2, 5))), "g": lambda: r.choice(CUES["glue"].split()) if r.random() < 0.4 else self.invent(1, 3).lower(),
            "G": lambda: r.choice(CUES["glue"].split()).capitalize() if r.random() < 0.5 else self.invent(1, 3), "M": self.model, "town": self.town_name, "title": lambda: r.choice(TITLES), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(10)),
        }[key]()

    def model(self) -> str:
        r = self.r
        out = r.choice([lambda: self.invent(1, 2) + r.choice(["Net", "BERT", "former", "GAN", "Flow", "Seg", "-XL", "net", "mark", "bench"]), lambda: self.invent(1, 3), lambda: self.invent(2, 2).upper()[:5], lambda: self.invent(1, 2) + self.invent(1, 1)])()
        return out.lower() if r.random() < 0.15 else out


def labelled(size: int, seed: int, keep: tuple[int, ...] = (0,), parts: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`size` passages of a few lines, each with its (start, end, kind). Lines and names come from the parts `keep` of `parts`."""
    r = random.Random(seed)
    m = Maker(r, list(keep), parts)
    out = []
    for _ in range(size):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            line = r.choice(r.choices([m.lines, m.open, m.plain], MIX)[0])
            shout = r.random() < 0.05
            between = r.choice(["\n", "\n", "\r\n"]) if r.random() < 0.7 else ", "
            at, parts_ = 0, []
            while at < len(line):
                end = line.find("}", at)
                key = line[at + 1 : end] if line[at] == "{" and end > 0 else ""
                if key and (key in KINDS or key in ("n", "y", "A", "w", "W", "h", "z", "zs", "g", "G", "F", "M", "town", "title", "hex") or key[:4] in ("cue_", "han_") or key[0] == "d" and key[1:].isdigit()):
                    parts_.append((m.fill(key).replace("|", between if between != ", " else "\n"), key if key in KINDS else None))
                    at = end + 1
                else:
                    parts_.append((between if line[at] == "|" else line[at], None))
                    at += 1
            for value, kind in parts_:
                value = value.upper() if shout else value
                if kind:
                    spans.append((len(text), len(text) + len(value), kind))
                text += value
            text += r.choice([" ", " ", "\n", "\n\n", "", "  "])
        out.append((text, spans))
    return out
