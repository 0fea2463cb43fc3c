"""Digests of full licence texts; written by tools/build_license_digests.py."""

DIGESTS = {
    "Apache-2.0": """
119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40
824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f
ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25
""".split(),
    "Artistic-1.0-Perl": """
e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2
""".split(),
    "BSD-3-Clause": """
21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651
321be07dc857ac0a93e4ea174716ca8c79576a80d3dffb27b0ee70b4bf6eb366
408786d8b38ed29f854d41636b729fc458d0461cfd3cbdbd87aabba49f48f4ac
5ce62a013b556071b7c633521daa59cc2a3f6f4a63cccc7f8b26f6dda9664aa2
cd15619ea6c89066477c9ab0f922a7a8dd620bc04404f7876b4cfdfcde120516
d94b8b074085c30ed18c0f525d36e9428dad32e4636b74cbc2842a699ed95176
f047c0f2ff5248b0d7fb5b5652fb276149f8e6f41cfdf6a0af0606bdeac874c4
""".split(),
    "CC0-1.0": """
cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e
""".split(),
    "GFDL-1.2": """
01f5ab67cbe57ba60274c0f19ea5a3e213e26690e4849b8d399d5f7d42a3dd40
05d44364d1084418770395e997c1069c0d0616f43e54c5d97d28e3db613fd597
064c000782fea69cb862df13f5f85e13ac693266c5ee54b08332e47bee35558a
07de740af5b35e3fed4f2e50f40aafba4aac3faed689138114af9e2e3b698a21
10e607be9bb222c61708cbf6947b5a7f08edc96f1da7abada793ca7fce09a356
1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f
224d86b528878e13bd1468b12475e650cf63d7ce30b1728cd95e852bf184b706
22736f665d9711e42c417dd47306c63cd1e7a698bb01ba7aa401ef40389db1da
2d7be51433a7a27903ff228a8c8bb166b3b5286ae64db13e34e5119d1418864e
3389ef8869fad0b790e4adf2f1901cfbcf83fa43c1a2493dce85e416de2f3520
389a6176948240336cce02026a23bb70c7036b214166b62ba3b2a8f31fda7c09
3b55ca5356019fdde0842f34cdee5aada3cc5f67eed85c28aa9f98943a7ae6f1
3b6fd42e1d617d0211de2c8364c99266fe4ba1b1c1b4a1d8d37713bc773d3a7b
42b970f6cf365eeb79ba2b6aa7c02029dea6e88fc502dafe6112d4c2799431e9
44b2338e29dca2ca2ff046fba6f6852583ac4966e6af203787a5caff968a1066
460679aa7a260215ea28364cec662e93428987d74e35c63a18690f202ed914c9
477847ae8d9a40be1cc5d42455f611f613f6dd2f7560bc52b9cc11f620e7b26c
4a411ad0cdf02edfa295641c01c038339ffbf9b4ddbf00fd87ae6dae92fe048e
4d18c3dce10e56f03e176b83e25676d65615e60c2bcdb324a3e6c2be081475bd
504980716f11311c91dcec5e52a090f11b2236958688fb517d9b34846f35397b
5d15377eb0fa7b0af9c5c9394bfd97609dbd2fc14e8e54115ebd34ec1445e142
5f9ee4c148c61cd6f83c70c5cf12eb66435ef220963379f6798c3c02e7c33c62
6306fbe257df58b4c1c0a0181f65ca574cf7667e3d896c8232e3ba351185a66d
677e233eb389b3c9a2340903afd87751add7579ecbc357c739c9cd124847c9cc
6b70993b684e793a95c43107e6ebd403d8b6a3d9a0675324e3fee5f89da24679
6d5951bdc8dc8f88d203076837018d75c4d31ff031ab678a5b28150912314e1e
6fad50746c1cf99e22af6b8b5c5da0df6447946cee0741fddcdc883538740746
77c739455a1a7dcbc9e941c49398cbdeaa157b603efe83ba7e3dbc0c57525597
79feac78b16c23771e25e96b0a05eed29b4ebb57ac4c532173d976886514f62e
8099e0dc95c8ced44061ca3bb6bfe2dbb98f570667f4577186664f0c75caca49
841a25b617bd8f0f6374e98c15fdf3e3193db1167f7491bd443d67e98c3497c9
87cddd686eac295be33892c791c193066a34bf57396bc954adf4afe85fbda5d9
8870e5967f922b7e719ec6ce8608bc36161428a3f91512359450b97f2443130f
8b6a4d80d67d293e3b3328f5e50d06499c5f3123810374bd8d2bab4a4b10bfcb
8d1fac02fe7be260ce806b294d7b60045d67055974dee9da5992ce7c3b6c44a0
9382324ac4975007f7620b5f6ffd6bf5981279e2b233dafad6f2e582876918c8
9a457119a9fd139d61a06de925e7bfacfeb9fcb2b1db001ae6cc2580c9a5b537
a2eb9c086f43202514157254d3535aa8ec9eada3d28b87996a16a04adaad7739
a5c2e39c4a42c31c18867ff8d74ee367773bede7eccb5f5fefea01e7d7ae5fc8
b08e1f7062af215b49217f369366f4c4d1003d8e7f99431d120a6628a3023d2a
c078acca5e9ad8bd35954b96f068a696dbe12c7d8f471f692036dc42acd490f4
c5a59323f5e1c2385bbb4ca43665780ff05233a0e7d49a5a0b1acf6c1593b5a4
c872b9226f545f3954928b455856933d0d28478ce014edc33672ae9c5986288b
d2ba9b19035ff31cdb03b00d1d99151e954631987feaded2ce4d5d3fd12474e7
d9a602b6a56d08a44724a244ece2174fa12f85880cfbe634ac7822521a3000da
eaedb1c11418f43a79d5caf71d0205578b9e2442534ca22e2537059a784698bb
ec600f80e8c9ea218e1d7934dcdccad02a739c709b866b66abbf8e38712039d5
f0e71c14cf66a54d59e650dfc71330ca8efb7c91d6e5d28cf035b13ad2c2d6db
f0fb5427dde0b89dd1170615456e96c930fc9aac20c185c9801cebf33b607ee9
f1d329034ee7c433662013b9140ef17206fc50f29dbe6b10934bbb251b0e87ce
f9ce69fad9ef73add1b092ffc85871b36deaa5368d13042f9e93e118aa1e4200
fbf45ab9861599c597f8a081e4e08dd3735232110552e9d1afd2accbb25db9a9
""".split(),
    "GFDL-1.3": """
02dcfe3404b522c7c5a417d843d18f488f7273cad9e2308a082b13c279a5f993
04e37aa04ff7230f6dd58ba83a152310111978f5f8f49636e3909744d1ad4ff3
06f2f604013cdf1f77b2c7422a98715eb317ca58e126d18e1620acca4e12ce1c
092eb33e2a7e61e24a2ba4e6e303a81bd350ea520a8f705b68748acb2f91436d
0a3f0210aad2c340ddc5cc74cbf8a4861da086424c2e1c172bd324cedf6b672f
14da62ff3842b0185408c79c1da533175b316d0470e9bf86e31b9bf375bb21a1
1d3ec36eb88462a41e45069b461bde3dcc6938f17a45f75af8a528554fa33ed2
1d728cdd4301af67f1e89ace879a82334da1072f90d92611600a43e7386b6a43
22c84f2a941475032b3e43b0f524164e07f64101221b22480aa6ec61dac91a99
23ff64c35f6afb989efb3ef54b491934f7ce0e8f1e0381f012c1c9a335ee5a59
32765535fad17fdee12f56a7073e256e847736cc1b9562b623c61b5ac089085e
360884ece07e7306528bfe9eb4de50ea089bece2152990d8ef77fc034fc1d791
4a11585457d200d99f354fedd94c124c31471307afa0aa96484614e6a2617012
4c683a36b8cbed1367043f138fdce7b4c0f7ce3ef9987f97a16becb5af13438e
511ce2cf128415f8c60f737a622adb96d4a5c831f4cbea80506edb8652a34093
53a1f1e3c91e5654c070ba2060db7ddad788c922a461b712737f375782d1c042
707d43bd43634031258bfcf5daf525c473393e4b9144e0e7800bc7d512b11468
77e8b5f0a35b094f16dfc7d41d83b5f454baa03fa0cbd42092af4552730dbbcf
796b3889d2b2da41ac9ffb26742a6407c6890fac45056770d7c7c5a80000db95
7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7
83dc0f1ce40d3aef554e1676e834171123676eab54212549750d49ad5af2dd7b
85a00962d20c43c2a43c22033d1e4f9488b925dbe34a8e5d4630bce5572b9ef4
914b7ebea1b6a42f38be6cb07eb3d7783cb3a45cc0947b3e978ffc5d830c0561
9227866922dd9aed81d05e1bb7ea82056737cebfb17ec59d0168db95c6714ff8
9627a88f646f29360ca19ac6ddedcc9f06d937adb586671e8bde600333873aeb
96acd434d462c1e4410eb1eecc6bd3bdc243346f46afe3d8f4e6de7f8e0756c0
a3b4c31d88ecda81eb7a3bd8d6208bf87a8056855fe0c203f8c5896d6b6523ca
a3dce0ba65c68ea101a40a0c41d47223a922e9e2de91fee3ae6626a91377b00e
a52b1c39a7eea3f70f050308723f7846cb605b7fef4f01f727ec472cb4d12461
a6a32c85ad5ae1963edef6b1244d97ea519a1433647e663de944f1904da4e57e
a6f62b3b6ec0bf3a00dcb7acedb3d54db0ce46811522bf1fff421d6403a45846
a7fe4306ffa37b29cbbc7ff354d5e5b0adb4c22aa99da7d9b73cd46212c1a0a0
ab7d3f2280ee00fa86981c79e93783980257a4242da0936b5d616f0455a3f3ba
acd09c52ddb02ccdc3758446e95219f39f22ed5426531cdb1a88ae12352fe2a3
adb2824bd9a4ad9075b740a1b6ac91a02f7d8c74dcc5e0a04793d1e96d81d0e2
c9de79f86e85bcc4f0aa47c67dda0d98724b01ad5f002ea470364fa601ef88a1
ccb4f75c33e67d71845830cc37fb3228fa8bc1bcc7813d6644ae1d3563a18eb0
cd14ff511a63dc7be0628f0508abff05952fa5a27a1d4266cc290206fca6fa88
cff75bd00e8e5b08276fc67dab604ae38ae70d8b550522fb3386bb8e31f6d534
d02a9a2c94bfe21e9c8effc61488e8a2a3cfc43c9968f956bb18990157cd44b1
d5aae69e4e758e4868ab8742b7d323a2a1d0fafb7ffad3bc2e6c831cca05d5ca
d5e54bb8100a342383c2d7e844e47bc5a417a9aac28acec68fd3c3d966a56afa
d61d4af9faba0f04e1c8337b03a3c9ebefacfd086d3e41ac561aac347620c0a9
d93694e2dcabcb70b3ad9a567e251a8874c4baff92193da093ecb76f6ce502ec
dc3df88fffd308b2e7c3721916483aed00d5ddc6458ec76472b5524c337fff50
e89b456711f0754da78fec8cb2c9b0df1ffcc7bf11eb7ba42505e7c6a75b6179
e8ab6ae03706dcf40e43c9e0d90fab99aaf74eb7b48cbce5bf71c28d767d7836
ea253899a40e9ba1eaf1c08c88be9ec5c05e0a25150af70efaecbb7dee4aceec
ea260bb705806d8830309dc7c12ad9c8d3e766931e88e1a79cad5d31308bd13d
eecc0c72f4964667f9db688a059818fe178469683d616406eed1b7929bab00ee
f2be0f0662240862071078acafd73f1d64a928f85a83cf5f30f0ef6d57b48b37
f7ead49ef9c0eb0d730724bc8f5af35263ba20289f416ebb056149609714394b
""".split(),
    "GPL-1.0": """
0602abce32d46c108b143402623ac3ce16cc06e52eea34ca39eb5cb9ca9b65e6
08254fe30063fceb8fe81c2f2cf6c1bce63b75a450ec490f86758713f134a5c2
175f511abd0d3fd5f48cd40e0aaac24652ada233ca289e42f8ffdc9dd5eb8a0e
21b801cbcf6bdb35ff73e0828975ae319eafce6bbe85c9d38077afa2c93cf9c0
24bc5345819daf657c4709aebe2be24875e021dde1ced86cd813b9ae9ae62a60
2d13f542bb87f1a099d0e1bf106e1961ba2bc27b08ef832e61921ad7f9124146
32dc8b5c7724d4862c79ee0adc870db2dacd6c74d258d1b6993033e40401cc8e
37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b
3ca217c03cb1074fd5b7dd5a2a0e773210437efc096c921084b31bbbdb6391b0
40566943a73219c7914e783f2d9af7248748e3c2f870fb9fdd543a01e1999d37
54dcfa02de978d74e4fdb5ffd89c72968a5eb80e1d86b3b1c52c89a37d577deb
58fbcc89de5bf1f8e05bd210cda4221702c612a318610b211d1e2d8510e61b66
6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc
64a9792015f47a81fd09833cb0f93892fdc04735979d25127fa66c873391737c
67b60ef91d7ed8029e13a68f4f17e7e7888490640f9f7e4e877415646877e45a
67d6692a57b3b7b6828a12a58acfa268021e66bf3af54d542d372b14f2e74b9c
6afd320156f545b9fbe35083974b21cebfba2772f000e24919a45445e687d3a5
708cac85d8fdec51d49c2dfa8776ac46911202b935f1dd15e5a4674aeed1d6b6
7667e7c3cc75f85efd9963d403b0d54da8616519e6d8358ea4009a06088bb700
7bef496016085359e884f0bd5bf6197906e54bb71730c03dffb0d5d9557bf40e
80226e5691b06727061548a249d89b5d4308c7a88f95e011a49bec70d7a8a9c9
80be38e8d9eb2e75f8ae6707d3bb8abad67c119b3b12703b84a50aea2fce92ef
86e9abe4a933ef070a871f4dd9937455d8e81b32a39a035f1d943e9a4b419413
89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70
8d532db07c50348d4e1ddbfae67ff85c6aa4a0c3590d73553ef3a354159c13fc
8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224
90b42d1cf0f9ef747c945cda0a54d5bd16341c8491956c54b3f4f283efa0176a
94a51f71e758a857bdc82629c53b51aadf21da681cad77ea346de82d788d4491
9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d
a2daa94686b09e2b2699f65dd1742b5c6b5ebd3e36666bd80d7c3aca12b8e556
b147fb1b60564f379acb02ff890210f6d84979bd4c8754772ffc27ef1c94fcb3
b378b953f1818a8a59267f0e237ab386c421cf10883fd76ef15015b1b0cde4e7
bd94f46419ae5683fba500e1295a22ec6f221407e07949eeb87e2109add22d36
c29bd366a342506f3486d72e8485c13b0682123d137a1923d1e7ed35382cc68f
c998c55766765ef27a95d6d1fd94086c426cfa749a90f2415890e6be9eef0c64
cb4004cdd18757223af13140927aa0217ea608cd1b6383e638a6595ea3ae5774
d2211d94d54db389c8f796d88d3c19a6299d3e8df7bb28905eae964dcce08eff
d408d9dad6e4560274412e743ec3ba01007197655029f60544c308bc54f80499
df355619eb9a29c442793a93383ad3439dd4b184c8a6064c6cd4c1353baa8a53
e15ccaee9f9ffb11790e52e6cb8e809b88238f3582d7407e27b09ea420af3c1d
e1aa76b1df89638966bc5e19369d3b504ab0b433cced554e5b6ce81bc9f7b58b
e705796a89c92ba8ec60b8ea874ca92a2e452d4d707b3ec2f785cade0b09bfc3
eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6
eea14bb214da450ef6cce57a65fd253c9c1b2bb3ca3634392027fe23b5c84703
f765f8fbe86ba16ebc6c65a35082ea74446fa5445f7b826c284b6de87abb57c5
f8c8dff717fa85a98e0b0cc6e3594ca5f9126de8e020d56267d8e25d50e2a33c
fc606b2f0b0ce350287eed3c052ac06090549da4ef58886a81421f58f7f6af35
""".split(),
    "GPL-2.0": """
011b3f7c17229b64afa7b13c40e482c1eb21a81b53c1d0e9d011f8f6ebabac32
0177932e2ab94f18eea40b722c6b7cf782e76fc85aa9977e917d1d84ef2b95ad
045a3d7e4a7ccf36616ae7f72dc90fd350f8d1777608553e32952c18f0b3408e
0b19a1d786d952023310ac9017fbc16e46838207247b02e3b236ec42912151a6
0b72fca7ee92e8c5e7e13832520dbe23d60b788cb236dbbf7713a43a70267837
0bfb659bf7eeb9921df1446a6a93beba70e0dc947eec10a42d26bb310dccd498
0eebaf2bc9864ea73313a343e6a5d3c3c84680773fa139e36715a554d7d7c6da
10d1d0f8c3ee7917ce317fc183ac8f2e686d35e35e93b61bf5e8b4d477a502af
138513a29a90cd8882743550619eaedbbcc1efb1b7d40af2e97d8e4f0a0e3910
14a434d3ce3d1f71497acec58108b62ab52679a9c058f9cca8f96f1a66c0f7d5
15c40eaf2ba0892dfeb52f040bf5d59d358964184855b1e377fa04bc0868dfaa
19329ee16e4a9fb2e74ce40708e49f5c315b4f0ac4653c556ca42027ba79f9f5
1b31765f3839369e3023abc203c02b561b2a666512b94717b1d68f69fb3394d4
21d011534d43eefbab3d6cd2be56dd40f05e54b2c85a42db8733931176701c62
22e078a036c47dcd7f1eb27820c0dbd3cf10ddbe4dd28dd2aa587a7ab6fc5be2
240615c1f68d2fc5963b67b044e8bc27c94889ceedd9432ab3b21ca92d5aed03
2abbbf12ebb21505d9ffbee67f2d648f435fbc0a27a00cf8a609fd1d456731c5
2eec9fad1ea5c6e2bc550e3466e1c69581c185492237d19edacdb69daea883ed
30f8e6b7479e71513657f45ac58038dc7ac37836d7874e7c01f5df0f10c6a8f5
3163d43833f22e45d36411522e839f187fbaa605644a0ce01cf819404a234e53
34cacbc5d4c8288f220e8dfade5276e6f76704f67150b4388c9ed3e3ff88cd90
34e784b300a09c759a1c80c12aa8ce856da805b6d4e18c464e7cdc7f076eb90b
3888536674a8749aeae9c2c25382fb7924a009adfdb613b9bb1dd51af5a68541
3d9df0b52ef2cc38cbf4bc6b64e938922aa438b3c64c725bc713e4d7a842fda9
40e8ea4bfed83b464edb5f55c32bde4369cd0ad980555566dc9483d5ee3aa449
41b3696737b7b7c07d86a3a760885f0ae20d38f7dd71c251907ab0b3aafe5475
443419dbb9972aa7b9ecd2597036e7440ec00c60c25ccabb68f48798c1191f86
4842c59ae7b7e43e7076c2c9017713e0c416f6978b5f5636f635751db549ab57
4a2605276725f014a98f15bf434eb9c6f39a7799faee06056bd042eeebf16759
4cd69aa812d18f39e5f577a0571401e4be728c879889baa308ae54468efa0208
537106d84cdea1ddb51e62e905a6cfad23b398c2273b6fe59a6d06ba27d5da63
53cdfb674fe390bbbd7d6382a54d55d1724edb093b295ab2f2d354fb7f4c6ff2
577a501eca6f0d1412120b6148691aa75d32aff766b4651fb5d8fa91d6c1f03d
5bd0f3def16d97b7bdab08821f4e4160b9e5746f54ccc78d60b117d2389e0d69
5c1dfa4733d037d02eb34351f654f4ced94d5c5ceb46cc8832d3bbc4b3d86d0a
5f694e6cff722127ba630c5610b247d18e468b5778c23e671ed9c1ca3ce5afb2
633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7
6911bc07559efa04a406a1f9038ea72d2ab96a67bfbe19807b73f607564a96fe
6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808
6d8ba61127611e2b85a426f6e2f74527664ccc16904cdbd299bff2cea6d1709c
6f769e56cb6559a33049ddd6c76a71bb7d1e2c2dba9a9d1309242bb0c6dfec03
73fdf7578f68cd5007f048230b11276a6fc068c37dbc6ea49f44a3e1d5a59da7
769eea2ceef3a069eca8719150c725058f3f2a66a295ea1b3727b68241a3e7c7
7af1eb318bc21e0f2da895587f99d961871a60ee825bf41395f67f009cdf1816
7e04748a98d35d3ad2a866ad12b6a33d90ae5778c356e6e036c0099d9a7e63cb
84248140da372409076c8ca1290fb9d266332aa780315534b58824aa38a6a056
8607b1cff63e9a9dc468bf76327bdd0bb2d2abe09d6e8076427fd49236f46f29
8a952f90a452c61ce415ff5fdf6692db51a6c0a2827e591fcb61b37cb2f59a28
8c7322182d6c8ba1ee33b211539a0a6ac283a22a819148b2aa1c6fb688706637
9339ab11be2a49924e6947c229d70c56efdc48872f93bde85ca00673d5b545f6
9581bd8649b4d0cfd79870345eee658b7e71184cc44038857e28ffe7cfd5f759
99481475ca567a57a0b539b2162a70b77d2f0ea5bed332b9e7e91df0cadbdfda
9d66140e215dbf5e8b188707e40da7e5fe4c6bfe2fe5d3dd2bc3f48df3f5f621
9f87c9b71e97eb1dfdc4d7a771a98fc30e35186e32ff21e7659edfe196ce797f
a1ea92cf6ce9a1425aa978462403f5a4f4e8ddb39b454d5eac790b02a2b7915a
a1f17f2f40b5613ac8c9754f62350449960974134ad75f65c097c79f1c1fbc2b
a324653f1da6191e96801b18202f6388cf1fb32e22f9491dc04323a611084f4b
a7babe34df480a90e02f809a446e916061f8a57b608beb582c04a4194af96a52
a9a162bec76e6c74f291411f7d0cc2c9b06844518684a83c31336a44280bee45
ab3ec7b9a3f158009e93c085caf0c6328776c3586897f110ee7f6fc87044ddac
aba277f49d5975ded88a5bbcd8756edb4388402af5fd48545ddd6ba6537ceea5
abd2ac9338038476646c121a1021a8b8f888ec2eac8cf2ea4684ea62c34d1e64
b01cc86f9068d51127625e94b653d27d81d6f36e31d234966bbb8b9bd40070ce
b0ef77b61f3c9f8a7669298510199f69632cc21e0afbd175d203edaf23c853be
b7c13c23a96686743a4228766b0db0920afa658489ee82e8f436d0269b475f66
b7f81dc9aaaa645304fde476859dc46db4e23b83ec1c50bd8462652ff46110c9
c00212cea04a731e4262f01e283549cab7d47f3ed722ae18323ba7129085df6e
c24f806d124f837ef35b4eccda6244959f250ac969d80d827fbcdbc9c38f1d88
c525970158f36595c22a7fe6cfc94e7e0bd7ab016edb18f6f04ad41b9fcacc9a
c63f495f37c3902d3135ca15c214bdb8a5fd9ea85fab372963ce96adddbdb5fd
c76b8e624a6d5ac7666e3430b287b6b564bd396d9099b700b9393c7de71fc7cc
c928252f428993b646c70c671425ec87aab1bc5abf42e7a179685a96469bd918
cc2c00607a866b9aa5485e3eee12dd6ac1c922940f0b61e46b18063633295aff
d19747d6521250350b780877027efeafea3a2f76cf128c682f98c2cf7ab6c5a6
d3ebc801aad865d0c7be926615d3628d4df36802576cd67b25cfcd70e35f67c1
d468b3cd2cc2037a1039cacaedcf59e787c700917fd0f716e8e94e0106d27ed0
d90535f8b197e63f280b561231d6d3fa823a35b24246c11fb43823ec151e17bc
d9305ab84ec0def22155114a6e04b5783efdf18c38aa0bc47317e3f2cb0be819
ddcd2a00202c765d06fa0ae5ab7d0c0f3bd846796994dc100185dff3009391ba
e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34
e1bcfaf28e42eba7ac6b0aa31f0165c8241a74641090fe675acc693f1a3e5df1
e648941f05d420f9aaff2c90b068a27dc44679b33278fb4f4d6d395bbf176dbc
efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821
f0d3382be96947dc75dbfc28901ea820847b42a4aaca6c606ebed7bc718b29fa
f1412332f5361d2a392bb637c3844ed3a32b7d701ac0e7abacce50b34a9a3afb
f2cf8997115c6265d84c7e3bcee7726d3b993e460f910144ca8d1b155f463c69
f3084edc3233e07d975450fbc80bc62d79ad0229fb553bba1e4336adb83e02f1
f9b79e7c986f489205d2789f687849c8c12806355c10507a2e2fda8e20bc86e5
fa122069953c02a601837fb46c9cb8bcd1501aab5482511af541a209947d2f17
""".split(),
    "GPL-3.0": """
00ddb1f89e09e5518464271c5b73e02617965e11da688e8973a253d741d8224e
015e2d6e3ef034d06a59332eea4c92e3d5d2ae53bd22815f680ef92c2413b2ad
038c6690c18a7ec3bb7a1c22511178e19f7e962eafc28b3f9d6f3759cfdebd62
092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191
0eef134773666b4d50fef30d18a90f50111ad5796b28db669febc31b762777b3
12ed3f6385ff9fba7df4ad83b0e6e3f8df5a5a24cc8450be4f340f4f257ea995
16de29a76f6b28590b2bedb93a813018fdd46d3f83da0f7a255fe7383cbc60f0
1918276b0a8377ccca61b376a6278129b2513c221db548ab8a2661d3151ae20f
2cdc572ed30945743c4abdf644624f20a245f97d3aa70251be632f4cc2550f66
2de8a21d7579c9c26598c78b27922c129ba8d488496234da57485419d1562c38
2e456cd4a7db067fcb47250dd3cd154eaff6e580389125b37bee1018cb027c1b
2eb13d6f38e30931f6909974b7d64d11dc0dd08e2e0d0779179865092751d347
3129d737330c12f3281f0f8fcd4799ddbc6f254181868ae29d6ca65827f0682b
3150e38bf866298260f6fb34878c705bd1d0074dd1ceec003a0d598cbc1d4bbc
3166a484f21908d33aa2f66764d602522ada5af635e9998a5db00f85be22cec9
34af7c7dcede95b41eff66dd9fc4b61316baba1cf1517d64fcd6542974887c5b
39a6efa3076af232de61a13d09b777c9757af7b24bc258ead3c3e02130c0c999
3c9744523328146e584d30e007da278a884c1dc273798cc3199b64532fae9839
42a5a7ee3005b89ebab00469572068ebec15ad9bd580ca86d41db434ef26386a
47cc7f3b816e65cbb0047f42e1acf84aad3ca3ee82858c2d04cb3573fff71c98
483d29728a883085a09fdc5bbfc5a79c842b4c6ff9b6a01cbd4f4d14dfe977d0
51431a4f4eeee37ef8d6d15437842a93d30426924407388290676f41f6d6452c
529c185e60fad7cb22229c867fafe28f241b0a64826d9abfee601f56010ed7cd
58df2b1ebdcf6fdf16e4fa493d3730ef9abcfcb70f7b5f4b6072689e01958ad8
5d19fc80b618d75f3ae12a4abee4f9c74b95da7a7d5d9a42f61b38decfec4d4e
5d57809fb42c45474b9e720cc5166b665c34f834fe9ff04349f312875605b6d8
5e3e55238477e496523b8c678b76cd1485924808edcdca03014d3fd4589a1706
5f9a16d8d81dfc9674a4e4f9408fb8caac3d60626eaf090bb0c40c0f9cd0eb14
65ad786b3890e31a0680602139a313ff87230b46ee3d2e9d9b23250a57210e7b
691807a195bcb46ebc9bca6da1854cd255b2a29ec985d45212fde90a89e05912
69dbc3ee6543d031b151a64eac243478ad2bd4be2a077ff8ee62c043c88758d8
6d2c2a12713f7a6cec1bf294d0fc9b2d0a7435cad53c4a5106cd4a5cfda072a5
7300741b7882c4cee1198306545302285397b5dbcfa263d41588b8b85e01aefd
73b92a4088dc5832e458194a659bde1314f553dc6fabd6b78f41dffd1e5dbd6c
74698385bf74151a173931d0259cb12939269c2ca4ca8096d6829d6149a048e0
757ce74e0572028f9916bdd65b7d9f0b63116d486bb20325f78bae904a3077ef
76a5cdfad1137b155c8c294ff12e56327be58cc57bc53474d9d87693b0e95d36
7875d465217c2552c4ab63425c7801331bd818351ac299d23420df081501a638
7b4abf08897a54242fbf3c63d63a7745393a06ef4a2481fb13d030e61f0a0775
7b8548768ae66f7351b4a8e86c8b92af55e75fd10d5fb5c5ae382cd0df3f5ce5
7d478223d8fcde6480339b8bbaadacf6b93d7007d04a13fbd30f71a80fd981a0
7d5abc57f09483baca5c807b1ec5d41d594faafce85d28236f586a5441176990
7e7aeeb14b986194feee1af71c8f41fd72e166cab77b3604001b85ab5a5dace2
830e066d18f4e75955e2b1359a608eb512a5b5db8563dd5c5f050a3ff188c93d
842a96b2b336a9e3bb001f79245a5e9ebe88c4aa9da275637baeba08ed7cd0a4
8491691ed0424d6aaeb9d0863d593c3712ccc20e86e15caf5de8daecad4bafbc
8c3d7ab7088ef4231215f6954d4e8896371c4e37272bbbc4dfe52c3cbf055227
8e2136f1b41e34943d111f610e09fc4be9e5b8429669f84c15217733c706792b
8fdf8b1ca551402ac353c415244cd2940e69180241f45b109fff0dcf49a3b5e4
939e85b3dafdebd91dab3052ed129a9d8611963a6cc0216ecec0e7bd35eaf05b
969fd5d620157eced8b632e4ba7154859f195397976b89e7ee716615116fc70a
9f1a8e0dd62fba042faa5f17e9a6d3d58916c8545c54255c86f3bdc0c44ddd5d
a427609091e26da51bbae76ae43d99d040ab14734c32629797b6f40ca16041d1
a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68
a926791d4c15910fd688d2856f348c4912f4e49311ada6928765f81bdae1fbd2
ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636
bba5a23e17eb3197e105c09d5fee9f84cd095e4fd2811a93ef4644f022656e26
c01e2da18b05b18f12d5284de2db81c04d1efc9cdc3abd2d4758e57d1304825d
c18730efd03e888e2a9394257a8732d6b5db250e6e2a602265025efbec37b57d
c46086ee9dee6838c4d4ea7734a35d539a80e635ad53a74f8a46b35bcdbfdace
c5dfddbc99d5359297177162fc4dba244c813c2b1d105bae18b52b8c9eca813e
cab0547bd7b5019d146931de051adc52be88fe724233e0e497e3d4d644e50eb9
caf91755cf33283be25f1e05efbd2839d225ef7def53695a510aed6dfdd1550c
cdf5da2893c7996be4875137b8fe77f75a6459a05070b9b49103f5da0989e1ac
d39aed46bf5ba1bacff3eed95e19da2e2c46ae28d29a5c23f04aa23b7113b57e
d9de3adc6f88fd297c319c8e5efae6a00c1606770b4d22bd8fdc95a7071b5251
da41f7fffb5da586b4ee3182a876f630eddb112d2f42fb0dee3cbad57815bbe6
dc70e853f91e5d57df3c12038a9932783277f428373c9d553da7db72286f5eb8
dde017351d67457891d444ea15bf6744e3608eb7cdd3664e2427cb7b455b1b68
e42b020bef9b3ae147e25c3443ca1ed97e8b4e3c56b03b74a4e588df5b859bef
e75006d456f1d7adea5814801cc7f97c544b138e944055fa08bfe268da1ff70e
e8a679baeda40505cb87eaad741ac82ef0bd47ff1d81bc2b1a75768f6272813a
ea1b8eb98ec23dda6fb609e7584abf1f58cc68b309b5144deeec720c6949346c
f028d55e1f0f1f28f0402085013661a375088fe9c2034492907332cc22e1ba1b
f2690e0d6f5e8b883271cd6c80d0f141890ed5a0a815262a97206823707690b9
f852a5ea8dfdd6edcadde5720957533dd9c91ab60f6750cccd500f6f4c197cbb
fbcafc5852fc829ce58480e17ab28db83258032933d4765c10869a55ba917d02
fca198e2a49eba2387a16e6afc72b017824fb9c00d194987dbdcc530b78f3392
fcc58fa0fe3677c2e55da71e8e5083a446656726f9ff4cbb15f01ed005e758af
fe742824840556d99c4abf7c0a330d2ca72befece70fc71866a0f6280e9ce762
""".split(),
    "LGPL-2.0": """
000c7888c3b71f0dc3a138f7eb821969a5314119c34432666942f7cfa9822501
020602b821185abb518739671f662560e86269ac82b9849d4194b86098f8f2b2
052bf540c98a4842bad8d9f2b372e7225b1eb1d38da3916a60bc288db5e37152
071eac888a9bd8984c959b4569b0499a03a9998f2a0dff7c2106c12465480769
0f1a211058d0d944de8033b4bbc532448a2b40cdaee93572b576aa0c1e92fcc0
10eee47427b44c98528061d45288b40906646627c4dbe263762b01bb5a9a4eaa
114866b0e8e369541ba33c41eac478bfc39412473ea94882f6f04563b049f9c8
12becc16f61ac7657a8b9aab4c9ef683084c0b9006d0409b049415ee0f5d0046
136499774f8b189b40cff7763428c6689510683760928a9832eb174bd951d6de
14be939ce088d4b577e438e1224762dbf818504b9d6eb057e5a5b04ce5c5c404
1c238cac67c0c50e2f8191b11c7f5fdba0a3d10b356bda06c0ac1a22881d37f9
1cacd02d86111add40672a52e9ca668c7c906b3ddc45482b4fa1628680a2b7fb
1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614
26a67ca7ecf4961b705c16da2b2b46b2ef5e27456a7b08f44ac931d9e052ee50
26c9c60ee071053bb5b95c46709f899719f57debebf6c392c0387ab70f02a6a0
34659e149e86120130a52027fe8aa3cc7d9bfc110604b46d1ca037f1e49c4cc9
385dd5c7c01c9cd28d24a01d15913fe551f7be8f8a62670d4d0cf6b2a3a48010
387a5221b7a42e749bc0228a894537359ee76bbd3c5f1110f688150afc8be220
3c503e1843d56bee44590ba959b2a745cf954688aa5dd285043d139d8c3e6cd6
3e884ff8ef33efc9ee0d8a6b8a26196c9ac72ccc695ea63f764a9364365f43a0
430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2
464be86a52c57edf54231edb986ff4df92858cee1c04b1e409bfd9f3c7a17b7e
4a68e6fb2c0c843c144c4ee5d54509e56d55ce5b9e332b0dd6c307a79ea59b54
4b848bfb76fc2360cd3954191eb20881e019fd8f9130d43ae14fb25a0ed226a7
4ceaea82727a48cc648fd726de4bad1619e98db4a5b52d1a35f61a429ad4dbef
504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260
53aef4456b3a87cd88b86caae8f3606bc4f72b326f7b314d19e6c968d7b42081
5814f80a2d9fc538f46a3a9883df30f45e44c7c7ab501d9338e10ba8e94a7426
5c9f3c9ad76609e3de05dff7db0e36fa942e91520d3d11124c30504ecaee47e6
61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908
671b34bf27d63bac0253d664d60a1254e49f2f1525fcfb2eb1a96a885e0dad4a
6910b504d6a288960816bb708e7a1b1276b3f306e7837299bb4c091d738b764a
6d21c6e131abcbc6ff230472968d9e90aec1bbb98190765fe695b8339e302347
6db80b468697498acc0dcf9c43bfb9947524bc2adf115de95f3fb15442016222
6f75229523a812f7ba9bbbcc49fcfadcd8160a41c4fb0ee3185890b8593a845b
7161d4bb84db1a90a7cdc3e7b01dfa74b345dab084a8f2c2ba20d9eadaa37216
76101e1932e92222c1e5e69676b0447b40e9c982910ac748bd7cdbb323962c71
775e7cfc5d76501a541170eac7c7abec610bc9d334f8a2de09dfd01bbee8d7e3
782dbbbf139179a28451f181540bc2e9357d29dd98b17f0a740dcdc20251cceb
7a7dd211312ca61195b1f0c8150057053f5e99fdd2d3774562623e853007b4cb
8035095587919b89783618c07bc89de36b17963f72e1c853f85829e991b4c7ab
8176d76db2f0af5ae829a21bcf6197857fb16e0ab2a3045b45a1a8db06c6c205
836740aff92324a4cb8e9b9f4afc1d2efc857aca91fcde0c03b761085b0ef651
83d969049bc3af736d94e97c17d5c083a010bb9a1085ef220dd02598bad75a59
84fad758b007e063d626909b7f24b28f70ad70b77a594c54feecc520d41f3505
89cac06c96adab55035818fdf0b512ebe2599b421fbcfbacdb9c764be1dd2d32
911594f442c206633a286c074734fd4e18d016c6400df6c3da30f1c16c6f0d19
9226e8f3d26b50d4a925c669f3354fe68e68279edfdc20b8008d3eb31844e0cb
92bcd8f6c66bb287235aed87a9b8ef87fad638c71898fc9547cb3a5a2d93f231
96c47047421b3be5cae9a68c75f37fdcf07945fba0a1d6db6a3b57f9c70f75a0
96c793325a4242d2fb6631f265d20bb0e50243c033edc9c2519b3fa7a07bf1d4
98591dac3a49667111715fcf94434961c68b58c5e1b760323c7aaae8e3fdbee2
98710f270583420fc967d34a88ff792f585273dbba82badb96da629fa7e4ac97
9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10
9d262ace78b658a8af5c3e8ebf6af96ace6f6fd534b849c8f2780eb2be31291f
9e78fa98415a9a8c863589ab742457328d22cd2319bbf585de04b27baf33a2be
a076b0ad9b5e637460ea44f5d395b491d4df0886cee66f6125299f6276766867
a11238e7a456685e76713f70e3667e5cdbc0d89f87544cfde3ad08b65f13038c
a1d17eaee69b0acf82494ed25367a5de1fc23474406d17ff81a7b1ee484363e2
a5bff099080c470a573c638e77a9bcd0db699f4fed80fc2e95b7bb09090f6f00
a83a990e22a60812a9e09b979bb23dd5a9f92588adb8de12185e92279b91926c
ae87c6bc7afbb1609abdd24fb3e7849f322e923a7ed56c1b7afba5a48858ba3f
b0191bc41c563bb0f53e8d324d52bae4f061a705e8f05d8e7fd208eaaaba7b9d
b523269884654ed187d2374a74bab552b2a3f2d233283f4e39abe8ba28ee23e3
b627cb91401f7506a8149c6d58531d8a329814f6532943451e0f814f22282f12
b696051cf47ed9bc8767cf33db64c9b474687a95de1e7bf15e331097549f1bd9
b74843961a7c295925e188862fccf82f2e9364152f294a073d0fe89291cc0698
b79c6cade426db5139ba7b0cbd64956d0b276bd0cd2ffc08da8f77353e2963fa
b9cd9b24dcca37cdc58881d206518ecd6f5aed1650b74051a9fe9d77a6a29be0
c1e821ab8e25fc8af06b75b15e37a67eefeb3c7d29ee4eff036a4077f7623cf3
c212bd8d302b1bdece1f445c1c6146e090caab40361e8d1c4d1a83bc1ba20698
c29b31dff52ff0037287b14a8a16caa1667d999cd581f5978e25822d3b0b5734
c65502190784c5a2d16befc5dc632b0496baf6e4bab7245c52746b49a2bbd15a
cc1f3677bf0fc6327a33b8e5528fd2e080f37cb249bd9a6fddd24edb1236cc9d
ccdf43a8c93c6c56fe3ad0f0c0d9276e2bc5ea92c8c56501a02c86a57a60035f
cd9a2e4b86475a8e6636de6ce4bc73d5143362040f5f44e227e0f24c5ba08248
d0f8e8278659dc1bd4cf4c4cabaa4b97e3b948b9d45b9d49ba450cec3c9ec577
d622628c2bbe61a7ff1e52ab33584bce567444da0aaecf2653c3b9e55025d71b
d80f58dd12342f44c89684f8662f0e359b48c8ce2c0a3ac4bf6cec04664ab055
d8130a93fe1e3e087fd3cc93306d5e9cb8d1dc6ffb9d00f1631c6587fad122f0
db29eda9526451c9fdfc997c626b2096830b706c237424218e55176fd1a3008a
e07abd5741f5b9cb65734b13f9c8f4f08bb7a03df6409ae7e3eeac9630724924
e2f396f1c04d7116df75d0bf31a0361d31240521d72ba42b116b634b29f1c990
e606b4a1f3251a2332db2695438974051398a29aced513dfb8e2fa295dea134c
e61c73aa4cf3d1d9ffa83c6f6a6efe13b411adb2234073fae4d4390655aca64a
e7ecb08f240f58455c2c9090ab912b4bb92385869e21cf6d5eddcdcfc74a1731
e9c504dd30de5711f1e0dd3042bb1565e520741aa2c2d8c2dd57f00d04e46910
ee08f18686e70228768a559ea30b89f33ab43fde58e366c281789d34376bac7d
efa145af5adc2067ff2f9480b678210e2bb0c5a43c4281c636e66e0537e90d7f
efdb6e15466ae6e73cb5428a2fa111590387df8279cb31193b1f53a4b88187e6
f3e05107d6a91a0be36603f6390aa84798859006fb3f32b5c13abcb07221505f
f42cb8c0d42cf64a0d6c6df5275d0f6ef0d699ef3c94ec0812c30bc058c89efb
f51728eb856e51e6247d4a023256f9cb9322abe784bdb65ecb82131ef29bfcee
""".split(),
    "LGPL-2.1": """
0746c5153e10d55dede2ef40a2d2ff92294db63120ee0f4cae91a7ff84dbd5fb
08ab62e4d600e5d40a0a94fdd471ceba71116e3ed3387f23a6c631524147f5e7
0a1faa6c826b8cbc4af8fc3d4afd95e23e4697a4c8bbb1d8981e79deb059cfc0
0a5b9fa74a22656100a6f4446c5504d7c2d6d4b14fa9a15967d8e022afc52942
0b7bebfda00c17cfbd62dce1eecaa76a16164e1d675394a3cf374292f8759c05
0bfc8b5150863f63a93fabd7614e58d57fc1081b541c389ba3bcaec66a0cc9bf
18239521a425d566ba73672ad0929dc8ddc7d51beae2f85345f7294fe1bb911e
23a6582a97553ae9165505559cfe9b0521c158fa6fe50811fbb45791fdf0d383
251ab388e1e72f41331780f6e747d31c80e42b27799d5200bda2b91508026f0d
2a7bae9f9ea850ef7d98bee19ab4471905c0cbe8a01fb1fa83c0e18e297955ea
2cde437ff32cab1de75c70b436d4899d5913543f419fd4f399ba7c852b65e457
372401000896cfc0f71aba31cd71ac3db47f1a539c7eef225f34031953a0090a
3ad3b7603af070f58ed8b6b8e0933623be4d953b8fcdc3c7a504a1b50e4613e4
4605b0fc2916cefaded2d1125a4a2ece8fdd862dfcf530facbe706d27b290f6d
467c4919fbb8a8b1831b1b6adafb83064378a376426342b9e65485c1708dfca8
48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4
49e26200c2fc9c1a1c35dbd96a476ec0299d40fa4c491de1ff59f92e673717c0
4b6c8b6edcff96f729116f00e0acbbdd350e4745bfd8bbbf298a22dba42e94a6
4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891
4fd677fbdfdd8133da12ceacb3f0e3eb3557fe2c66dd50ad018604fd724db378
5392b720028fb61bf8e910de04667b2f222ddffab29aab0fa7dae333b0fa8e21
549bd3f958ea4e34bb960450398316977ce259327e45ef2720ff859edbcca8f5
55e9b72f860fad592f47e4d6360b6a50d030f5f8dd5adebb0ada80498931c993
5b244897812a0aa77a7fc631e94da33f11a753e0ccac92524fa3a9852a32db4e
5bc35ec74af8848a47ed010eb59c2464343aed9755f858a6847251b9b4905dd8
5c02ffed82d387ca9d246392e639966618941e3c3a46a957d6a50b5c2bad7142
5d412840d611a00c61f5e67a1e9b99a256cfdd5b6643e417f23aeccbf4c1ae9c
5e17555ef64a5df95620196a4b7381e641f3b95230acffc2a250214a7ed46b1d
6278cd103fccf790e80c6f78113d4c03a19bc662ccde99c74240d15cd686cbd5
68159adec3acf126fd638182d88bb4ff4d6a2538dc1aea101b2599467981c5ae
693fddb427645a31fb4bd5c9c5d08fb0d99548ffed74638afae4cc1d09cfe368
69cc0560b51927331de8d0e46c1c1cfe598ffb842d453fff55bb6b23c6d9f649
6ca730b3c63f3cc9eafdc840ecdc83e9e5b31bd4f38c2f1b10accc32bbeaf38f
6d05f602d7a9f9950f9537100bd504a7fdab92cfe89f4f94b0d15721ee014b1f
6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5
6f09b5e27ad84a693be0b38cfc935a25636a3d7a6fec554e0a3530b6ca427a2b
702037216780112403a3e69e4e85e83da281408b5af89ad448b6ee221b233ca5
71dd3625f3da3f811dbaf98422c4f6ee5b1d5225afbe00ec0feb6b60b3b68048
78589aaab2f36ad54d13298ca317c71d1e2996e5c94c34ccfc16c297c48480b7
7c548051687ee119ab4c0fe194a4bc20cdacee87894f65294fd8bf7bca37b4d7
7c879232e75ff9effcaec40c0d976f52a8a0712a154542548635c044a4e75148
7e3306d026498136b24fb10edc6dac91069fcece1550a999feab971cfd4a16b2
82166f55bef2f116a92e28b93171792efe44fa602d7f8b61cec2d133f0445ea7
828f51224c84f910d5a88a242e7a1a8d7e6a3d168f71b34120d260721b87fa21
9310c27e700477166661c82004e0a717f9ecf704980001736eed1914efc7aa1d
945d8088e2fc91a043fdccde7c79bba43c9469bc3bcac949a7b4358b1a3c0266
947f8469f2f79d92357c78d2d65cbfee48e8e7912f40ff853d6e456a4e097360
9539d2593463e102be646cfdd403b4b1e54aedbc89ee4861a2b16c225d27ba04
9614076f3f6b5b2ca2cb7e27eb568507a8fe23ac19babf1b19b737b564705e70
98ee2ec068a51049ed400919bcc9b031bd9fcb4141726f51e23b5f0196a2d37a
9b25ff64d12e20a9b0ae94a2197d00a9b25bbd0888dde6485ca0595faef39cd3
9c8aea52ac2706a35452528904b5cef7c0aa4140e5ec04d54ba60f53c4a5c78b
9d26e9bee2a01eb7e9d7542e56890681cad5a8bdef8ae756418e2ec9a90012e5
a4ae735c0097e371fe8b9910ade6d393d4ed7f6bd3d9c321b979808466954000
a4ee65dfc58feaba1887b30bfb94857460a7ff9777ca3ad05a0e251fc9d401e6
a6742add8db4ff9ba6917da0bd1f95927436acfd65ae81933f1e9a859d38d9fa
a864c006fcea233008e33905c0a306d36bca191adf8a297b71d34f77646f8cd8
a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15
af29577f607ba7f5fabbbbf9233116f4be07c7b582b60f9b464c2f1303ee2a3f
af418e2a6d65af8e56ac773984a3f8a26918524d2d39b01c3097f908fdd35428
b1d5c946d153ed2760361867b0bf37bf7cb28a3de72f1f2f98bfa0cfc01bca5c
b3eaa7e5a69616fef48ed906e4a9d85fe1f3a5c091fd9bd5bcd6209d37b9798f
b722e85e376c24a6eb7338ec47bd50bfb4c86c7069abff2da16203c12238dbaf
b7df10941a29000db7fabf62eac587f34f9c5fb583f377cc684dfe6a5ffe05fb
bb3b07a377189d33d62290c762b4426eccdc144a6d6e303879e78115645aa469
bd74db1d2fd87c3c00d3a382cab2cb5ee71c71c09b7f978864167963074003e3
bee379056899fa831119e16ac56299994609fc92fb9706fd8098c6cf06531041
bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df
c10561965ebbbe16c09d21b688b49dcdffdb41e9775759b588ca2e2c9f231641
c30d27e66b9a27a9333584e1153806909e66c8df86a45c8040b14461968ed3fa
cec15582eb5bfe71547a4d98a864d3eec739a344af0b6c86181634afd94e358d
d00d08192018b2217de04b223449941a18a7cb07d0c025393948065a12eb0fb2
d0c97d1d9a8cb0632d409a7a976317c886d9bab8cc1fd65bdc574cb6c3a77af0
d27950373e882a757f9e36369e58060896f9f0dc6faf9a7ef1e15cc843ff2b91
dce5bc60af0031a89ea244eaa17d5c3b24490f6a5ff87f4f52ca8aae720f0597
e507467df57f1d93d2cd9fd2dda721a9a422ddb014205c7328f7169513d968fc
e73c71e01c6dc86b163ece905db1759843696355b09e96902ee15f8c769c828a
e8ae2a0bf64a4e26db581480fea34e506f03837cf38b7056e56280d7840936c1
e8ebe2513d0bd90d40bb6e894699a044e69aa9b44afada1fb47e767c3fed7f15
ed46381f869f1ed30f31851dc04f195f0ca988cec36486ceaab798ddce0e342c
ef2ae08b17c2736fa472f6e9717505b617a83b4af7b067420b24d740898bbec0
f13ce8aa4b0cc0de7c3b73a95e705f217972ef8710e7c0a463342682e2e523de
f2bb3ab9488e8ebb63c17a5de79e654c291abd741dbe8a016f219e6d2e561d12
f86abc4286c4aad76c8d7473c52faaaf4e52342b0fd3a2baab0543c78e4ca842
fabcd69c1216239cfc845511108049135006299c0cfe03d6a136bfb8347225c4
fcef020de3b1d2bd35f090b4f441bb11789eec93edd7e50d51b0a2ae9a696a11
""".split(),
    "LGPL-3.0": """
0719a819c37632ea87534698076fef260737b6d20304a00a32635a0afb8766c8
0b51dca48af3e10263907396cdd4168344528e7837e1ab8eeef12d51880eaf5a
11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8
2333c56e2ce1311e119999a68b2e7c4db6e2c58c0742e6fb54e1baf109273e68
28c02e5059cc8836701b81df00f39c1b9eb00fd5700044146988468f4dd2076b
3ce770135de37fc153de7af30789ebf6cf1e9ad54eb9b487647ea8aa9ccae9c2
492965fae74f56d7701fa6f8627a87daf0f5f317d4036f980188cd8d4f401c07
49e45cede7a47479ce2ddffc2f5bf85307cec05bd319cbb585f8b7baeefdbbf4
4c2d055810db499fcb7a72d99679df8dee59c323051ae4fc90f5ac569cebac1d
585e067881a295f8bb2fe75d5c504301903c3d66b1b60ca444d8f4823c8ddd74
5994f37b761fab87ac94f5e8598c5189f1368a7b99635ce2f84ea44bcc420b44
5a93730f14120e8e31d29755c73bed9733e34807ae90aece00cfae0033b34fba
63f16a6808ef8dfa21c2ea61b3f84e9b02208b9032233b9104d82a29a42afdb6
652c2a29802a84605109893c29c8c522a4c59f7dc8d1ac1d9ab383386ba1f7fc
7c4296e98f1d1c0a00c4c44654acaf683b03c0584ff99c5c494ef6430463e3e3
935bbe3ca9e2483d5ca24e682365ec45c12c5d0fbad3c887885110d189babc2c
959655dfd758f1d5e31f072aab38acdca6566d7b0039fc6e36b14114e318923f
aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be
b21f9c18457de2b29ed22dee5728495515a9bbccd27ce167136506b64226fbee
b4199c517a4d5a09962b403cc1b48f32aedfd57f849397add2e98bd6fb3d5cf9
c32d8a3ff1a28744297c057a323b87c5fa8c128712132552b2d3429d1eadb968
d8f14bd6df8ee0950533860da3b97ec7a1e656f4c2fa5d48451cc6069fe691e3
e29af455ddc1781f5822c34cca614d2881afd763372285c2f09bcfeea54b8588
f4cfb1ca7b561624096eaafcfe3f3ec8b21def9c08de031b3bd7e02a3250ec11
fbec5fa6afd53e3cf1493f0b5098b00412e4382472392ebb4557ca58a06ebd0f
""".split(),
    "MPL-1.1": """
03130a880e566e3c5474efb5fea6f9ca35e05b24d3b7ff108f49981c3a2160fa
26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986
4be4a6251869e153404f424bbd1c116ada60f8969d5610b406e2a430e206b0bc
""".split(),
    "MPL-2.0": """
6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d
""".split(),
    "Unlicense": """
e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229
""".split(),
}
