"""Short texts labelled by hand, on which the classifier of document kinds is calibrated."""

HOLDOUT: list[tuple[str, str]] = [
    ("prose", "We moved into the new flat last week and it is quieter than I thought. The neighbours said hello on the first day."),
    ("prose", "i think we should call the bank again because nobody has answered the letter we sent in march and it is getting late"),
    ("prose", "User: Did you find the keys?\nAssistant: Yes, they were in the drawer.\nUser: Thank you, that is a relief."),
    ("prose", "[user] can you look at the draft again\n[assistant] Sure, I will read it tonight and tell you what I think."),
    ("prose", "Le train avait du retard et nous sommes arrivés très tard. Ma sœur nous attendait devant la gare avec une lampe."),
    ("prose", "Ich habe den Brief gestern gelesen und noch nicht geantwortet. Es ist nicht so einfach, wie du denkst."),
    ("prose", "No sé si la reunión es el lunes o el martes, pero me han dicho que hay que llevar los papeles de la casa."),
    ("prose", "The rain\nhad stopped when\nwe left the house and\nthe street was full\nof leaves. Nobody\nsaid a word."),
    ("prose", "THE OFFICE IS CLOSED ON FRIDAY. PLEASE COME BACK ON MONDAY AND ASK FOR A NEW APPOINTMENT."),
    ("prose", "# Notes\n\nShe told me about the trip. It was long, and they were tired, but the sea was warm and they want to go again."),
    ("prose", "Мы долго гуляли по городу и говорили о книгах. Потом пошёл дождь, и мы вернулись домой."),
    ("prose", "今天天气很好，我们去了公园，看到很多人在放风筝。晚上一起吃了饭。"),
    ("prose", "ok, see you then"),
    ("prose", "He paid 35.20 for the ticket on 2023-02-01. It took him 3 hours to get there, and 2 more to find the house."),
    ("prose", "Call me back.\n- Anna said she would come.\nWe waited for an hour and then we left. It was cold.\nNext time we take the car."),
    ("list", "- milk\n- eggs\n- bread\n- two lemons"),
    ("list", "1. call the dentist\n2. pay the rent\n3. water the plants\n4. write to Jon"),
    ("list", "* sourdough\n    * rye flour\n    * salt\n* soup\n    - leeks"),
    ("list", "[ ] tax form\n[x] spare key\n[ ] train pass\n[x] photos"),
    ("list", "tent\nsleeping bag\ngas stove\ntorch\nrope, 20 m\nfirst aid kit"),
    ("list", "• The door has to be painted before the winter.\n• The window in the kitchen doesn't close.\n• The garden needs a new fence."),
    ("list", "a) la tarta\nb) el pan\nc) las setas\nd) el queso"),
    ("list", "#1 Brot kaufen\n#2 Oma anrufen\n#3 Fenster putzen"),
    ("list", "Things to bring along when we go to the lake next week:\n- towel\n- sun cream\n- book\n- water\n- hat"),
    ("list", "3 x onion\n1 x cabbage\n250 g butter\nsalt\n2 cloves of garlic"),
    ("list", "(1) le jardin\n(2) la cave\n(3) le toit\n(4) la porte"),
    ("list", "9:00 standup\n10:30 dentist\n12:00 lunch with Mia\n15:15 budget\n18:00 choir"),
    ("table", "name\tage\ttown\nAnna\t34\tLyon\nBen\t41\tGraz\nCarla\t29\tVigo"),
    ("table", "| day | hours | paid |\n|---|---|---|\n| Mon | 4 | yes |\n| Tue | 6 | no |"),
    ("table", "id;amount;date\n1;20.50;2023-01-02\n2;13.00;2023-01-05\n3;;2023-01-09"),
    ("table", "item        price     stock\nlamp        19.90     4\nchair       45.00     12\ntable       120.00    1"),
    ("table", "+------+------+\n|a     |b     |\n+------+------+\n|1     |2     |\n+------+------+"),
    ("table", "date,open,close,volume\n2023-01-02,10.1,10.4,1200\n2023-01-03,10.4,10.2,900"),
    ("table", "These are the figures for the year.\n| month | rain |\n|---|---|\n| Jan | 40 |\n| Feb | 31 |\n| Mar | 55 |"),
    ("table", "town      km\nOslo      12\nBergen    460\nNarvik    1400"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgdGV4dA0KSGVsbG8gYWdhaW4gYW5kIGFnYWlu\nUXVpY2sgYnJvd24gZm94ZXMganVtcCBvdmVyIGxhenkgZG9ncw=="),
    ("junk", "00000000  4d 5a 90 00 03 00 00 00 04 00 00 00 ff ff 00 00\n00000010  b8 00 00 00 00 00 00 00 40 00 00 00 00 00 00 00"),
    ("junk", "xq7%Kd{} zPl03&& vT/9Qw+ hhR2:: Lk%3D 8fGt/x9 mmQ{} 7yTb&& pL"),
    ("junk", "##########\n=====\n!!!!!!!!!!!\n~~~~~~~~~"),
    ("junk", "🎉🎉🎉🎉 💥💥💥 😂😂😂😂😂 🔥🔥 ✨✨✨ 🎉🎉"),
    ("junk", "CÃ\x83Â©tÃ\x83Â© lÃ\x83Â\xa0 mÃ\x83Âªme chÃ\x83Â´se, Ã\x83Â\xa0 nÃ\x83Â´uvÃ\x83Â©au"),
    ("junk", "wq krtzp bnml xxvd qwrt zzpl mnbv kjhg fdsw rtpl bvcx"),
    ("junk", "%PDF-1.4 %���� 1 0 obj<</Type/XObject/Length 4820>>stream �x���"),
    ("junk", "8f14e45fceea167a5a36dedd4bea2543 c9f0f895fb98ab9159f51fd0297e236d 45c48cce2e2d7fbdea1afc51c7c6ad26"),
    ("junk", "$$$$ ---- //// \\\\\\\\ **** ^^^^ @@@@ ____ ||||"),
]

# Learned from, for forms that a corpus may have few of; none is in HOLDOUT.
SEEDS: list[tuple[str, str]] = [
    ("prose", "Вчера мы были у бабушки. Она рассказала нам, как они жили в деревне и что пели по вечерам."),
    ("prose", "私は昨日、友達と映画を見ました。とても面白かったので、もう一度見たいです。"),
    ("prose", "Το πρωί πήγαμε στη θάλασσα και το βράδυ φάγαμε όλοι μαζί στην αυλή."),
    ("prose", "yes of course, I will be there at six"),
    ("prose", "thank you so much"),
    ("prose", "She said that\nthe road was closed\nand they had to walk\nfor an hour before\nthe bus came. It was\nraining."),
    ("prose", "no\nI don't think so\nbut you can ask him when he is back from work\nhe will know what to do"),
    ("prose", "Human: where did I put it?\nAI: You said it was in the blue box.\nHuman: oh right"),
    ("list", "8:30 school run\n9:15 call with the bank\n13:00 pick up parcel\n16:45 swimming"),
    ("list", "apples\npears\nrice\nolive oil\nsoap"),
    ("list", "Berlin\nParis\nMadrid\nRome\nVienna\nPrague"),
    ("list", "2 x AA battery\n1 x torch\n10 m cable\n4 screws"),
    ("list", "Packliste:\n- Zahnbürste\n- Socken\n- Buch"),
    ("list", "I. intro\nII. method\nIII. results\nIV. end"),
    ("table", "id\tname\tqty\n1\tbolt\t40\n2\tnut\t38\n3\twasher\t90"),
    ("table", "city       pop\nLima       10\nQuito      2\nBogota     8"),
    ("table", "k;v;w\n1;2;3\n4;5;6\n7;8;9"),
    ("table", "+----+----+\n|x   |y   |\n+----+----+\n|4   |5   |\n|6   |7   |\n+----+----+"),
    ("table", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"),
    ("table", "time,temp,wind\n08:00,12,3\n09:00,13,4\n10:00,15,4"),
    ("junk", "qz xv jj kkw pprt zzx bvn mwq"),
    ("junk", "====\n----\n****\n////"),
    ("junk", "U2FsdGVkX1+abcDEF0123456789ghijKLMNopqrSTUVwxyz==\nQmFzZTY0IGxpbmVzIG9mIG5vIG1lYW5pbmc="),
    ("junk", "���� �� ÃÂ©Ã Â¨ ÃÂ¼ ����"),
    ("junk", "❗❗❗ 👀👀 💯💯💯💯"),
    ("junk", "{}{}[]<<>>;;;:::%%%&&&"),
]
